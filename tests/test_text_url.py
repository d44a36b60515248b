from pyspark.sql import functions as F

from searchlake.functions import porter, text, url

PAGE = "<title>Go, Now</title><p>I am 42 x1 <b>GO</b></p><script>var t=1;</script>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit(PAGE))) == ["go", "now", "am", "42", "go", "var"]
    assert one(spark, text.page_title(F.lit(PAGE))) == "Go Now"
    found = one(spark, text.weighted_tokens(F.lit(PAGE)))
    assert [(t["token"], t["weight"]) for t in found] == [("go", 1.0), ("now", 1.0), ("i", 1.0), ("am", 1.0), ("42", 1.0), ("x1", 1.0), ("go", 1.0), ("var", 0.001)]
    assert one(spark, text.tokens(F.lit(""))) == [] and one(spark, text.tokens(F.lit(None).cast("string"))) is None


def test_snippet_highlight_fixed(spark):
    page = "<p>" + "word " * 60 + "needle " + "tail " * 100 + "</p>"
    cut = one(spark, text.snippet(F.lit(page), ["x", "needle"]))
    assert cut.startswith("...") and cut.endswith("...") and "needle" in cut and len(cut) == 80 + 350 + 6
    assert one(spark, text.snippet(F.lit("<p>short</p>"), ["short"])) == ""
    assert one(spark, text.highlight(F.lit("a <Space> spaces"), ["space", "a"])) == "a &lt;<mark>Space</mark>&gt; spaces"
    assert one(spark, text.fixed(F.lit(float("nan")), 3)) == "0.000" and one(spark, text.fixed(F.lit(2.0005), 3)) == "2.001"


def test_porter():
    # examples of the paper
    pairs = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit triplicate:triplic formative:form hopeful:hope goodness:good revival:reviv adoption:adopt effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil"
    for pair in pairs.split():
        word, want = pair.split(":")
        assert porter.stem(word) == want, word


def test_canonical(spark):
    cases = {"HTTPS://A.com/P?q#f": "https://a.com:443/P?q", "http://a.com": "http://a.com:80/", "http://a.com:8080/x": "http://a.com:8080/x", "/no": None, "": None, "http://A.b?x=1": "http://a.b:80/?x=1"}
    df = spark.createDataFrame([(k,) for k in cases], "u string").withColumn("c", url.canonical_url(F.col("u")))
    assert {r["u"]: r["c"] for r in df.collect()} == cases


def test_links(spark):
    cases = [
        ("https://a.com:443/x/y", "/z?q=1#f", "https://a.com:443/z?q=1"), ("http://a.com:80/", "//b.org/p", "http://b.org:80/p"), ("http://a.com:80/", "#top", None),
        ("http://a.com:80/", "mailto:x@y", None), ("http://a.com:80/", "/i.PNG", None), ("http://a.com/x/y", "../z", "http://a.com:80/z"), ("http://a.com/x/y", "z%20a", "http://a.com:80/x/z a"),
        ("http://a.com/x", "HTTP://B.c", "http://b.c:80/"), ("http://a.com:99999/x", "/y", None),
    ]
    for base, href, want in cases:
        assert url.resolve(base, href) == want, (base, href)
    df = spark.createDataFrame(cases, "base string, href string, want string")
    found = df.select("*", url.simple_link(F.col("base"), F.col("href")).alias("simple"), url.resolve_column("base", "href").alias("full")).collect()
    for r in found:
        assert r["full"] == r["want"]
        assert r["simple"] in (None, r["want"]) or "99999" in r["base"]
    html = """<A class=x HREF='/one'>One <b>x</b></A><a href="/two">2</a><a name=n><abbr href="/no"></abbr><a href=/three>3</a>"""
    assert one(spark, url.extract_hrefs(F.lit(html))) == ["/one", "/two", "/three"]
    assert [(a["href"], a["text"]) for a in one(spark, url.extract_anchors(F.lit(html)))][:2] == [("/one", "One x"), ("/two", "2")]
