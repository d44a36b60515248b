import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlake.llm import bpe_corpus as bpe
from searchlake.llm import garbled_text as gt
from searchlake.llm import leaked_passages as lp
from searchlake.llm import markup_templates as mt
from searchlake.llm import page_body as pb

VOCABULARY = Path(bpe.TOKENIZERS) / "byte_bpe_50k.json"
DOCS = "doc_id long, text string, ids string, host string, url string"


def docs_frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", None, None) for i, t in enumerate(texts)], DOCS)


@pytest.mark.skipif(not VOCABULARY.exists(), reason="the public vocabularies aren't there")
def test_ids_equal_the_reference_encoder(spark, tmp_path):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(str(VOCABULARY))
    public.encode_special_tokens = True
    random.seed(6)
    texts = [None, "", " ", "<|endoftext|> x", "a\x00\t\n  b  ", "é́ ÿ 你好 🚀👩‍💻 \ufeff", "aaaa" * 3000, "don't we'll 12345 §½"]
    texts += ["".join(random.choices("ab cdé’\n1_<>ÃŁ", k=random.randint(1, 60))) for _ in range(400)]
    found = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(docs_frame(spark, texts).drop("ids"), "doc_id", "text").collect()}
    assert found == {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert bpe.encode_corpus(docs_frame(spark, []).drop("ids"), "doc_id", "text").count() == 0


def words(text):
    out = "".join(c.lower() if c.isalpha() or c.isdecimal() else " " for c in text)
    return out.split()


def brute_leaks(docs, items, run):
    found = set()
    for d, text in docs:
        w = words(text or "")
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for i, passage in items:
            p = words(passage or "")
            if any(tuple(p[k : k + run]) in grams for k in range(len(p) - run + 1)):
                found.add((d, i))
    return found


def test_leaks_against_brute_force(spark):
    random.seed(7)
    vocabulary = "ab cd ef gh ij kl".split()
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(5, 40)))) for i in range(12)] + [(90, None), (91, "ab cd")]
    docs = [(i, " ".join(random.choices(vocabulary, k=random.randint(0, 80)))) for i in range(60)]
    docs += [(100 + n, f"X,{p.upper().replace(' ', '… ')}!") for n, (_, p) in enumerate(items[:6])] + [(200, None), (201, ""), (202, items[0][1]), (203, items[0][1])]
    frame = spark.createDataFrame([(i, t, "c", None, None) for i, t in docs], DOCS)
    found = lp.aligned_leaks(frame, spark.createDataFrame(items, "item_id long, passage string"), run=6, n=3)
    assert {(r["doc_id"], r["item_id"]) for r in found.where("longest_run >= 6").collect()} == brute_leaks(docs, items, 6)
    assert lp.aligned_leaks(frame.limit(0), spark.createDataFrame(items, "item_id long, passage string")).count() == 0
    assert lp.aligned_leaks(frame, spark.createDataFrame([], "item_id long, passage string")).count() == 0


def test_alignment_scores_edited_copies():
    p = np.arange(20)
    assert lp.smith_waterman(p, p) == (40, 20, 20)
    edited = np.concatenate([p[:10], [99], p[10:]])
    score, end, run = lp.smith_waterman(edited, p)
    assert (score, end, run) == (39, 21, 10)
    assert lp.smith_waterman(np.array([-1, -1]), p)[0] == 0


def test_edited_copies_are_aligned(spark, tmp_path):
    p = [f"w{k}" for k in range(30)]
    copy = [x for k, w in enumerate(p) for x in ([w, "new"] if k % 7 == 6 else [w])]
    rare = [(200 + k, " ".join(p[k : k + 5])) for k in range(26)]  # no run has a seed that the copy alone has
    frame = spark.createDataFrame([(1, " ".join(copy), "c", None, None), (2, "w0 w1 w2 w3 x", "c", None, None)] + [(i, t, "c", None, None) for i, t in rare], DOCS)
    items = spark.createDataFrame([(7, " ".join(p)), (8, "w1 w2 w3 w4 w5"), (9, "w1 w2")], "item_id long, passage string")
    found = {(r["doc_id"], r["item_id"]): (r["score"], r["longest_run"]) for r in lp.aligned_leaks(frame, items, edited=True).collect()}
    assert found[1, 7] == (56, 7) and found[1, 8] == (10, 5)
    assert not any(d == 2 or i == 9 for d, i in found)
    assert {(d, i) for d, i in found if d > 2 and i == 7} == {(i, 7) for i, _ in rare}
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/eval_items.parquet")
    assert (1, 7, 56) in {tuple(r)[:3] for r in lp.p9_alignments(spark, str(tmp_path)).collect()}


def test_recall_of_edited_copies(spark):
    random.seed(13)
    words = [f"{a}{b}" for a in "ka lo mi nu re sa ti vo".split() for b in "bar del fin gos hum".split()]
    passages = [[random.choice(words) for _ in range(60)] for _ in range(40)]

    def edited(p, how):
        out = []
        for w in p:
            if random.random() >= 1 / 8:
                out.append(w)
            elif how == "replaced":
                out.append("zzz")
            elif how == "inserted":
                out += [w, "zzz"]
        return out

    docs = [(f"{how} {i}", " ".join(["intro"] * 5 + edited(p, how))) for how in ("replaced", "inserted", "deleted") for i, p in enumerate(passages)]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in lp.aligned_leaks(frame, spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, passage string"), edited=True).collect()}
    for how in ("replaced", "inserted", "deleted"):
        hits = [i for i in range(40) if found.get((f"{how} {i}", i), 0) > 0.5]
        assert len(hits) >= 36, how
    # a plain alignment of one pair, cell by cell
    text, p = dict(docs)["replaced 3"].split(), passages[3]
    rows, best = [[0] * (len(p) + 1)], 0
    for w in text:
        row = [0]
        for j, v in enumerate(p):
            row.append(max(0, rows[-1][j] + (2 if v == w else -1), rows[-1][j + 1] - 1, row[j] - 1))
        rows.append(row)
        best = max(best, *row)
    assert found["replaced 3", 3] == pytest.approx(best / (2 * len(p)))


def test_alignments_in_groups():
    random.seed(9)
    pairs = [(np.array(random.choices(range(-1, 5), k=random.randint(0, 40))), np.array(random.choices(range(5), k=random.randint(1, 20)))) for _ in range(60)]
    assert lp.smith_waterman_many(*map(list, zip(*pairs))) == [lp.smith_waterman(*x) for x in pairs]


CLEAN = "Le marché propose des pâtes, du thé fumé et des œufs frais. À l’été dernier, une forêt âgée a brûlé. Müde Wanderer trinken süßen Tee. Сервер ждал ответа и потом удалил старые ключи. Каждая запись хранится дважды. The café isn’t naïve — “two” of €5."


def test_garbled_text_is_found_and_repaired(spark):
    kinds = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "mac-roman")]
    texts = [CLEAN] * 60 + [None, "", "plain ascii", "你好，搜索 🚀", "a\xa0b\u200bc"]
    want = {}
    for right, wrong in kinds:
        table = gt.byte_table(wrong)
        garbled = "".join(table[b] for b in CLEAN.encode(right))
        want[len(texts)] = CLEAN
        texts.append(garbled)
        want[len(texts)] = CLEAN
        texts.append("".join(table[b] for b in garbled.encode("utf-8")) if wrong == "latin-1" else garbled)
    lost = len(texts)
    texts.append("Gdzie� ko�o m�yn")
    found = {r["doc_id"]: r for r in gt.repaired_texts(docs_frame(spark, texts), "doc_id", "text").collect()}
    assert set(found) == {*want, lost}
    assert found[lost]["lost"] and found[lost]["places"] == 0
    assert sum(found[i]["repaired"] == t for i, t in want.items()) >= 0.8 * len(want)
    assert gt.repaired_texts(docs_frame(spark, []), "doc_id", "text").count() == 0


def brute_segments(x):
    """All maximal scoring segments, by taking the best one and both sides of it."""
    if not len(x) or max(x) <= 0:
        return []
    sums = [(sum(x[i:j]), -(j - i), -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
    best, length, i = max(sums)
    i, j = -i, -i - length
    shift = lambda found, by: [(a + by, b + by) for a, b in found]
    return [*brute_segments(x[:i]), (i, j), *shift(brute_segments(x[j:]), j)]


def test_segments_against_brute_force():
    random.seed(8)
    for _ in range(300):
        x = [random.choice([-3, -2, -1, 1, 2, 3]) + random.random() / 100 for _ in range(random.randint(0, 14))]
        assert sorted(gt.segments(np.array(x))) == sorted(brute_segments(x))


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("Fine <b>bold</b> &amp; so", ["html"]), ("cut </spa", ["html"]), ('ref="/x">text', ["html"]), ("&lt;p&gt;x", ["html"]), ("a&nbsp;b", ["html"]), ("# Head\ntext", ["markdown"]), ("a **b** c", ["markdown"]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("[x](/y)", ["markdown"]), ("a `b_c` d", ["markdown"]), ("== H ==\nx", ["wiki"]), ("[[a|b]] and ''c''", ["wiki"]), ("{| class=x\n|-\n| a || b\n|}", ["wiki"]),
        ("; a : b\n:: [[c]]", ["wiki"]), ("so \\textbf{x} $w_{1}$", ["latex"]), ("\\[ r = 1 \\]", ["latex"]), ("x<br/>y **z**", ["html", "markdown"]),
        ("If a < b and b > c, R&D keeps <= 5.", []), ("5 * 3 cells, not as 5*3 rows in max_tf and doc_len", []), ("C# uses {braces}; costs $20, then $30, #1, ** of five ** -- no", []),
        ("Set [sic] the key_range in C:\\data\\x", []), ("Home | Blog | Help", []), ("", []),
    ],
)
def test_kinds_of_markup(text, kinds):
    assert mt.kinds_of(text) == kinds


def test_plain_text():
    assert mt.plain_text("<h2>Head</h2>\n<ul><li>one<li>two</ul><p>a &amp; b</p>") == "[heading] Head\n[item] one\n[item] two\na & b"
    assert mt.plain_text("```python\nx = a*b*c\n```\n**bold** [l](/u)") == "[code] x = a*b*c\nbold l"
    assert mt.plain_text("== H ==\n[[a|b]] ''c''\n{|\n|-\n| x || y\n|}") == "[heading] H\nb c\n[row] x ; y"
    assert mt.plain_text("\\section{S}\n\\begin{equation}\nr = 1\n\\end{equation}\n\\textbf{b}~\\cite{k}") == "[heading] S\n[formula] r = 1\nb"


def test_template_classes(spark):
    texts = [("h", 1, "<b>x</b> [[y]]"), ("h", 2, "<b>z</b> w"), ("h", 3, "]] <b>q</b> [["), ("g", 4, ""), ("g", 5, "plain")]
    found = {(r["token"], r["id"]): r for r in mt.token_classes(spark.createDataFrame(texts, "host string, id long, text string")).collect()}
    assert found["<b", 1]["class_id"] == found["</b", 1]["class_id"] != found["[[", 1]["class_id"]
    assert found["<b", 1]["support"] == 3 and found["<b", 1]["in_order"]
    assert found["[[", 1]["class_id"] == found["]]", 1]["class_id"] and not found["[[", 1]["in_order"]
    assert not any(i in (4, 5) for _, i in found)
    assert mt.nest([(0, "<a", 1, True), (9, "</a", 1, True), (3, "<b", 2, True), (5, "</b", 2, True), (8, "x", 3, True), (12, "x", 3, True)]) == [(1, 0, 9), (2, 3, 5)]


def test_classes_decide_what_is_markup(spark, tmp_path, monkeypatch):
    over_lines = [(f"**from here\nto there{i}** on", "https://a.example/x") for i in range(4)]
    strays = [("**from here\nto there** on", "https://b.example/x"), ("**from here\nnowhere", "https://b.example/x"), ("a **stray and **b** too", "https://b.example/x")]
    rows = [(i, u, None, t) for i, (t, u) in enumerate(over_lines + strays)]
    results(spark, rows).write.parquet(f"{tmp_path}/search_results.parquet")
    # on a, the class of both signs is valid in all four texts; on b, their vectors differ, and only partners on a line are markup
    assert {tuple(r) for r in mt.p7_found(spark, str(tmp_path)).collect()} == {(0, "markdown"), (1, "markdown"), (2, "markdown"), (3, "markdown"), (6, "markdown")}
    plain = {r["result_id"]: r["text"] for r in mt.p7_text(spark, str(tmp_path)).collect()}
    assert plain[1] == "from here\nto there1 on" and plain[4] == strays[0][0] and plain[6] == "a **stray and b too"
    real = mt.classified
    constant = lambda texts: real(texts).withColumn("tokens", F.transform("tokens", lambda t: t.withField("faced", F.lit(False)).withField("complete", F.lit(False))))
    monkeypatch.setattr(mt, "classified", constant)
    assert mt.p7_found(spark, str(tmp_path)).count() == 0


def test_templates_against_brute_force(spark, rows):
    random.seed(10)
    pieces = ["<b>x</b> ", "[[y]] ", "# h\n", "\n* i ", "&amp; ", "\\emph{z} ", "w "]
    texts = [(random.choice("gh"), i, "".join(random.choices(pieces, k=random.randint(0, 6)))) for i in range(40)]
    frame = spark.createDataFrame([*texts, texts[0]], "host string, id long, text string")
    found = {(r["host"], r["token"]): (r["class_id"], r["in_order"]) for r in mt.token_classes(frame).collect()}
    vectors, places = {}, {}
    for host, i, text in texts:
        for t in mt.lex(text):
            vectors.setdefault((host, t.name), {}).setdefault(i, []).append(t.start)
    assert set(found) == set(vectors)
    for a, va in vectors.items():
        group = [b for b, vb in vectors.items() if a[0] == b[0] and {i: len(p) for i, p in va.items()} == {i: len(p) for i, p in vb.items()}]
        assert {b for b in found if found[b][0] == found[a][0]} == set(group)
        orders = {tuple(n for _, n in sorted((p, b[1]) for b in group for p in vectors[b][i])) for i in va}
        first = {o[: len(group)] for o in orders}
        assert found[a][1] == (len(group) == 1 or (len(first) == 1 and all(o == o[: len(group)] * (len(o) // len(group)) for o in orders)))


def test_nested_commands_of_any_depth():
    assert mt.plain_text("\\emph{a \\textbf{b \\mbox{c \\emph{d \\text{e}}}}} f") == "a b c d e f"


RESULTS = "result_id long, query_id long, url string, title string, preview string, host string, id long, text string, tokens string"


def results(spark, rows):
    return spark.createDataFrame([(i, 1, u, t, p, "h", 1, "t", "k") for i, u, t, p in rows], RESULTS)


def test_marks_of_every_grammar_are_tokens(spark, tmp_path):
    texts = [":reply", ";Term : text", "! a !! b", "a\n::reply to it", "<!DOCTYPE html", "no mark: none; at all!"]
    results(spark, [(i, None, None, x) for i, x in enumerate(texts)]).write.parquet(f"{tmp_path}/search_results.parquet")
    assert {tuple(r) for r in mt.p7_found(spark, str(tmp_path)).collect()} == {(0, "wiki"), (1, "wiki"), (2, "wiki"), (3, "wiki"), (4, "html")}
    assert {r["text"] for r in mt.p7_text(spark, str(tmp_path)).where("result_id < 3").collect()} == {"[item] reply", "[item] Term : text", "[row] a ; b"}
    random.seed(8)
    signs = [*"<>&;:#*_`~=+-[]{}|!'\\$()/\"\n ", "a", "br", "x=", "lt", "section", "http://x", "1"]
    for _ in range(20000):
        text = "".join(random.choices(signs, k=random.randint(1, 8)))
        assert not mt.kinds_of(text) or mt.LEXEME.search(text), text


def test_markup_of_a_table(spark, tmp_path):
    rows = [(1, "https://a.example/x", None, "<b>x</b>"), (2, None, None, "**y**"), (3, "https://a.example/x", None, None), (4, "", None, ""), (1, "https://a.example/x", None, "<b>x</b>"), (5, "x", None, "word " * 20000 + "''z''")]
    results(spark, rows).write.parquet(f"{tmp_path}/search_results.parquet")
    assert {tuple(r) for r in mt.p7_found(spark, str(tmp_path)).collect()} == {(1, "html"), (2, "markdown"), (5, "wiki")}
    plain = {r["result_id"]: r["text"] for r in mt.p7_text(spark, str(tmp_path)).collect()}
    assert plain[1] == "x" and plain[2] == "y" and plain[3] is None and plain[4] == ""
    results(spark, []).write.parquet(f"{tmp_path}/none/search_results.parquet")
    assert mt.p7_found(spark, f"{tmp_path}/none").count() == 0


def test_rendering():
    page = "<html><head><title>T</title><style>x{}</style></head><body><nav>Menu<p>more</nav><p>one<p>two <b>bold</b><ul><li>a<li>b</ul><table><tr><td>x<td>long<tr><td>yyyy<td>z</table><div style='display:none'>no</div><script>1</script></body>"
    blocks = pb.render(page)
    assert pb.layout([b for b in blocks if not b.region]) == "one\ntwo bold\n- a\n- b\nx     long\nyyyy  z"
    assert {b.region for b in blocks} == {"nav", ""}
    assert pb.page_body(page).startswith("one") and pb.page_body("") == ""


def test_tags_cut_at_a_lines_end_swallow_no_lines():
    preview = 'Own text </spa\nAdvertisement\n<img src=\nAller au contenu principal\n<div id="foot">x</div>\n<a\n  class="k"\n  href="/u">link</a> <div\nid=foot hidden>no</div> <br\n/>end </p\n>z'
    blocks = pb.render(preview)
    assert {b.line: b.text.strip() for b in blocks} | {5: "x"} == {1: "Own text", 2: "Advertisement", 4: "Aller au contenu principal", 5: "x", 8: "link", 10: "end", 11: "z"}
    assert [b.region for b in blocks if b.text == "x"] == ["foot"]
    assert {line for line, _, why in pb.judged_lines(preview) if why} >= {2, 4, 5}


def test_foreign_lines(spark, tmp_path):
    preview = "Own text about shards.\n\nHome | Blog | Help | Contact\nThe footer of a page adds little. © 2020 Viku Review\n<nav>anything</nav>\nThe crawler stores no cookies between two fetches.\nWe use cookies. Accept all\nA privacy policy for logs was drafted."
    rows = [(1, "https://www.viku.example/x", "Own title – Viku Review", preview), (2, None, None, None), (3, None, "", ""), (4, "https://www.viku.example/x", "Notes on a | notes on b", "Own."), (5, None, "Home » Topics » X", "x " * 50000), (1, "https://www.viku.example/x", "Own title – Viku Review", preview)]
    results(spark, rows).write.parquet(f"{tmp_path}/search_results.parquet")
    found = {tuple(r) for r in pb.p5_found(spark, str(tmp_path)).select("result_id", "field_name", "line_no").collect()}
    assert found == {(1, "preview", 3), (1, "preview", 4), (1, "preview", 5), (1, "preview", 7), (1, "title", 1), (5, "title", 1)}
    results(spark, []).write.parquet(f"{tmp_path}/none/search_results.parquet")
    assert pb.p5_found(spark, f"{tmp_path}/none").count() == 0


NOUNS = "harbour kettle meadow signal orchard valley ledger lantern pigeon quarry basket anchor copper winter ladder pepper".split()
VERBS = "keeps finds carries follows answers builds moves counts".split()
FURNITURE = [
    "Questo sito utilizza i cookie | Accetta tutto", "Zoeken · Contact · Sitemap · Privacybeleid", "Deel deze pagina: Post Afdrukken", "Meer van § Courant", "Inschrijven voor de nieuwsbrief", "Tutti i diritti riservati © 2019 §",
    "Browse: Sport – Politik – Wetter – Kultur", "Menu » Notizie » Meteo » Annunci",
]
CONTENT = ["Copyright law changed in 1976 after long debate.", "The use of cookies in holiday baking goes back to 1600.", "A privacy policy was drafted in March after long talks.", "Most read the letter twice before they signed it in autumn."]


def learned_fixture(n=400):
    random.seed(12)
    sentence = lambda: f"The {random.choice(NOUNS)} of {random.choice(NOUNS)}s {random.choice(VERBS)} {random.randint(2, 900)} {random.choice(NOUNS)}s near the {random.choice(NOUNS)}."
    rows, want = [], set()
    for i in range(n):
        site = f"site{i % 25}"
        lines = [(f"{sentence()} {sentence()}", False) for _ in range(random.randint(1, 4))]
        if i % 7 == 0:
            lines.insert(0, (CONTENT[i // 7 % len(CONTENT)], False))
        for _ in range(random.randint(0, 2)):
            text = random.choice(FURNITURE).replace("§", site.capitalize())
            mixed = random.random() < 0.2
            lines.insert(random.choice([0, len(lines)]), (f"{sentence()} {text}" if mixed else text, True))
        want |= {(i, k) for k, (_, bad) in enumerate(lines, 1) if bad}
        rows.append((i, f"https://www.{site}.example/{i}", None, "\n".join(t for t, _ in lines)))
    return rows, want


def test_wording_is_learned_from_layout(spark):
    rows, want = learned_fixture()
    frame = results(spark, rows).select(F.col("result_id").alias("id"), "url", F.col("preview").alias("text"))
    for known in (False, True):
        found = {(r["id"], r["line"]) for r in pb.foreign_pieces(frame, known).collect()}
        assert len(found & want) >= 0.9 * len(want), known
        assert len(found & want) >= 0.95 * len(found), known
        text = {i: t.split("\n") for i, _, _, t in rows}
        assert not [text[i][k - 1] for i, k in found if text[i][k - 1] in CONTENT], known


def test_best_run_stands_between_capitals():
    weights = {w: 3.0 for w in ("copyright", "^ copyright", "search", "contact", "^ search", "search ·", "· contact", "·", "contact $", "page", "share this", "this page", "share", "this")}
    assert pb.best_run("Search · Contact", weights) > 5 and pb.best_run("Long words follow here now Share this page", weights) > 5
    assert pb.best_run("Copyright law changed in 0 after long debate .", weights) < 0.8 * pb.best_run("Copyright", weights)


def test_bodies_of_pages(spark, tmp_path):
    page = "<html><body><nav>Menu</nav><p>The own text of page {i} says a thing or two.</p><p>Zoeken · Contact · Sitemap</p><ul><li>first item</ul><a href=/x>only a link</a></body></html>"
    rows = [(i, f"http://s{i % 5}.example/{i}", page.replace("{i}", str(i))) for i in range(40)] + [(90, None, None), (91, "http://x.example/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    bodies = {r["page_id"]: r["body"] for r in pb.p5_page_bodies(spark, str(tmp_path)).collect()}
    assert len(bodies) == 42 and bodies[90] is None and bodies[91] == ""
    assert bodies[7] == "The own text of page 7 says a thing or two.\n- first item"
