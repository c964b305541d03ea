"""What the contracts ask for in corners: ids that repeat or lack, long texts, bytes of every value, hot lines."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm import SF, TOKENIZER, brute_force, check_packed, docs_of
from tidemark.llm import chat, html, language, packing, queries, repeats, toxicity
from tidemark.llm import decontaminate as decontaminate_module
from tidemark.llm.decontaminate import contaminated, decontaminate


def letters(rng, n, of="abcdefghij"):
    return "".join(rng.choice(of) for _ in range(n))


# repeats


def check_repeats(spark, rows, length=200, parts=3, **options):
    got = repeats.digest(repeats.remove_repeats(docs_of(spark, rows).repartition(parts), length, **options)).collect()
    want = brute_force([(t or "").encode() for _, t in rows], length)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i is not None, i or 0, *w) for (i, _), w in zip(rows, want, strict=True))


def test_texts_without_ids_are_told_apart(spark):
    rng = random.Random(21)
    shared = letters(rng, 260)
    rows = [(None, shared + letters(rng, 40)) for _ in range(3)] + [(5, letters(rng, 300)), (5, shared + letters(rng, 30)), (5, shared + letters(rng, 30)), (None, None), (None, "")]
    rows += [(None, rows[0][1])] * 5 + [(7, "z" * 150)] * 4
    for parts in (1, 4):
        check_repeats(spark, rows, parts=parts)
        check_repeats(spark, rows, parts=parts, route_bytes=500, group_docs=1, task_anchors=3, chunk=50)


def test_equal_ids_and_checksums(spark):
    """Texts with one id whose crc32 agrees (the tail is searched for) aren't mixed up."""
    rng = random.Random(22)
    head, seen = letters(rng, 260), {}
    while True:
        t = head + letters(rng, 40)
        other = seen.setdefault(zlib.crc32(t.encode()), t)
        if other != t or len(seen) > 200_000:
            break
    assert other != t
    check_repeats(spark, [(1, t), (1, other), (2, "x")])
    check_repeats(spark, [(None, t), (None, other)])


def test_a_common_line_and_a_very_long_text(spark):
    rng = random.Random(23)
    line = letters(rng, 150)
    rows = [(i, letters(rng, rng.randrange(0, 400)) + (line if i % 3 == 0 else "") + letters(rng, rng.randrange(0, 400))) for i in range(240)]
    long = letters(rng, 3_000_000) + rows[1][1] + "ab" * 300
    check_repeats(spark, [*rows, (999, long)], chunk=3000)
    # lines of all lengths around a window's, dealt out by places from a few occurrences on
    for n in (100, 120, 185, 199, 200, 230):
        line = letters(rng, n)
        some = [(i, letters(rng, rng.randrange(0, 300)) + (line if i % 3 else "") + rng.choice(["", "same end " * 5]) + letters(rng, rng.randrange(0, 300))) for i in range(60)]
        for options in ({"hot": 6}, {"hot": 6, "group_docs": 4, "task_anchors": 40}, {"hot": 25, "group_docs": 7}):
            check_repeats(spark, some, parts=5, **options)


# language


def code_length(data, probe, order=3):
    """Bits of ``probe`` under the trees of ``data``, by the recursive definition."""
    whole, seen = b"\n\n\n" + data, [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]
    for i in range(3, len(whole)):
        for k in range(order + 1):
            seen[k][whole[i - k : i]][whole[i]] += 1

    def bits(context, c, k):
        if k < 0:
            return 8.0
        n = seen[k].get(context[len(context) - k :])
        if n is None:
            return bits(context, c, k - 1)
        total = sum(n.values()) + len(n)
        return -np.log2(n[c] / total) if c in n else -np.log2(len(n) / total) + bits(context, c, k - 1)

    text = b"\n\n\n" + probe
    return sum(bits(text[i - 3 : i], text[i], order) for i in range(3, len(text)))


def runs(data):
    b = np.frombuffer(b"\n\n\n" + data, np.uint8).astype(np.int64)
    return np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)


@pytest.mark.parametrize("kind", ["random bytes", "cyrillic", "two scripts"])
def test_codes_are_exact_over_all_bytes(kind):
    rng = random.Random(24)
    make = {
        "random bytes": lambda n: rng.randbytes(n),
        "cyrillic": lambda n: letters(rng, n, "абвгдежзийклмн ").encode(),
        "two scripts": lambda n: letters(rng, n, "абвгд 日本語かな abcé").encode(),
    }[kind]
    data = make(20_000)
    code, n = runs(data)
    table = language.Trees(["x", "none"], [code.astype(np.uint32), code[:0].astype(np.uint32)], [n.astype(np.uint32), n[:0].astype(np.uint32)]).table()
    probes = [make(300), b"", bytes(range(256)), b"\xff" * 9]
    got = table.lengths(probes)
    for i, p in enumerate(probes):
        assert got[i, 0] == pytest.approx(code_length(data, p), rel=1e-9)
        assert got[i, 1] == 8 * len(p)
    if kind == "random bytes":
        assert got[0, 0] / len(probes[0]) > 8


def test_und_is_learned_where_it_is_a_label(spark):
    rng = random.Random(25)
    rows = [(i, letters(rng, 400, "qwxz "), "und", None, None, None, None, None) for i in range(40)] + [(100 + i, letters(rng, 400, "aeiou "), "vo", None, None, None, None, None) for i in range(40)]
    rows += [(500, None, "vo", None, None, None, None, None), (501, "1 2 3", "vo", None, None, None, None, None), (502, "x", None, None, None, None, None, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, docs_of(spark, []).schema)).collect()}
    assert all(got[i][0] == "und" and got[i][1] > 0.9 and got[100 + i][0] == "vo" for i in range(40))
    assert got[500] == got[501] == ("und", 0.0) and got[502][0] == "und" and got[502][1] > 0


# decontamination


def brute_overlap(doc, item, min_overlap=13, penalty=3):
    """Best overlap over every way an item can lie on a document, or None if none is an overlap."""
    best = None
    for at in range(1 - len(item), len(doc)):
        k = [i for i in range(len(item)) if 0 <= at + i < len(doc)]
        now = top = same = 0
        for i in k:
            hit = doc[at + i] == item[i]
            same += hit
            now = max(now, 0) + (1 if hit else -penalty)
            top = max(top, now)
        whole = same == len(item) if len(item) < 8 else top >= min(min_overlap, -(-9 * len(item) // 10)) or same * 5 >= len(item) * 4
        if whole:
            best = max(best or 0, top)
    return best


def test_overlaps_against_all_lays(spark):
    rng = random.Random(31)
    word = lambda: letters(rng, 3, "abcd")
    items = {n: [word() for _ in range(n)] for n in (1, 3, 7, 8, 12, 16, 17, 30, 60)}
    docs = {}
    for i in range(150):
        n = rng.choice(list(items))
        part = list(items[n])
        a = rng.randrange(0, max(1, n // 4))
        part = part[a : n - rng.randrange(0, max(1, n // 4))]
        if n >= 12 and rng.random() < 0.5:
            part[rng.randrange(len(part))] = "other"
        docs[i] = [letters(rng, 6) for _ in range(rng.randrange(0, 12))] + part + [letters(rng, 6) for _ in range(rng.randrange(0, 12))]
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    want = {(i, n): v for i, d in docs.items() for n, t in items.items() if (v := brute_overlap(d, t)) is not None}
    for options in ({}, {"broadcast_seeds": 0}):
        got = {(r.doc_id, r.item_id): r.overlap for r in contaminated(docs_of(spark, [(i, ", ".join(d)) for i, d in docs.items()]), bench, **options).collect()}
        assert got == want and len(want) > 60


def test_a_clean_row_stays_beside_a_leaked_one_of_its_id(spark):
    rng = random.Random(32)
    item = " ".join(letters(rng, 6) for _ in range(30))
    long = " ".join(letters(rng, 5) for _ in range(60_000))
    rows = [(None, "clean text"), (None, "x " + item), (4, "clean too"), (4, item + " y"), (5, None), (6, ""), (7, long), (8, long + " " + item), (None, "x " + item)]
    bench = spark.createDataFrame([(1, item, 3), (2, item.upper(), 3), (3, None, 3), (None, "", 3)], "item_id long, text string, doc_id int")
    left = decontaminate(docs_of(spark, rows), bench)
    assert left.columns == docs_of(spark, []).columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in left.collect()) == sorted((i or 0, (t or "")[:5]) for i, t in rows if item not in (t or ""))
    assert decontaminate(docs_of(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate(docs_of(spark, []), bench).count() == 0


def test_no_tokens_cross_an_exchange_with_the_seeds(spark):
    rng = random.Random(33)
    docs = docs_of(spark, [(i, " ".join(letters(rng, 5) for _ in range(50))) for i in range(20)])
    held = decontaminate_module._seeds(docs.select("doc_id", decontaminate_module._tokens(F.col("text")).alias("h")), ["doc_id"], ["11101101"])
    plan = held.repartition("seed")._jdf.queryExecution().executedPlan().toString()
    assert "h#" not in plan[: plan.index("Exchange")] and "array<bigint>" not in plan[: plan.index("Exchange")]
    assert held.columns == ["doc_id", "pos", "seed"]


# packing


def test_fills_are_the_fullest(spark):
    rng = random.Random(34)
    for _ in range(200):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 100)
        counts = {k: sizes.count(k) for k in sizes}
        got = packing.best_fill(sorted(counts, reverse=True), counts, room, [])
        sums = {sum(c) for r in range(len(sizes) + 1) for c in itertools.combinations(sizes, r)}
        assert sum(got) == max(s for s in sums if s <= room) and all(got.count(x) <= counts[x] for x in got)
    assert sorted(sum([1000, 24, 1000, 23][i] for i in b) for b in packing.minimum_bin_slack([1000, 24, 1000, 23], 2048)) == [2047]
    # two powers of two pad less than one sequence of 1536
    assert sorted(sum([600, 400, 24, 512][i] for i in b) for b in packing.minimum_bin_slack([600, 400, 24, 512], 2048)) == [512, 1024]


def test_added_tokens_and_equal_rows(spark):
    end = "<|endoftext|>"
    rows = [(1, f"a{end}b"), (2, end), (3, f"  {end}  {end}{end}x "), (4, "<|endoftext|"), (5, f"one two{end}\n\n three")] + [(9, "equal rows")] * 300
    got = packing.pack(docs_of(spark, rows), TOKENIZER, window=64, bucket_docs=20).toPandas()
    check_packed(packing.pack(docs_of(spark, rows[:5]), TOKENIZER, window=64).toPandas(), rows[:5], 64)
    tok = __import__("tokenizers").Tokenizer.from_file(TOKENIZER)
    assert got[got.doc_id == 2].doc_tokens.iloc[0] == 2 == len(tok.encode(end, add_special_tokens=False).ids) + 1
    same = got[got.doc_id == 9]
    assert len(same) == 300 and same.sequence_id.floordiv(1 << 40).nunique() > 5


# chat


def test_the_mask_covers_what_was_said(spark):
    rng = random.Random(35)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "INST]", "é", "日", "\n", "a", "ok ", "🙂", ">", "]"]
    rows = [(i, t, rng.choice(["user", "assistant", "assistant", "[/INST]", "\\", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))) for i in range(120) for t in range(rng.randrange(1, 5))]
    rows += [(1000, t, "assistant" if t % 2 else "user", "long ✓ " * 3000 + ("</s>" if t == 7 else "")) for t in range(12)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = defaultdict(list)
    for i, _, role, text in rows:
        by[i].append((role, text))
    figures = {r.conv_id: r for r in chat.digests(out).collect()}
    levels = set()
    for r in out.collect():
        levels.add(r.level)
        said = "".join(x for role, x in by[r.conv_id] if role == "assistant")
        assert [(t.role, t.text) for t in r.turns] == by[r.conv_id]
        raw = r.formatted.encode()
        for s in r.loss:
            assert raw[s.byte_start : s.byte_start + s.byte_length].decode() == r.formatted[s.start : s.start + s.length]
        f = figures[r.conv_id]
        assert (f.n_turns, f.loss_chars, f.loss_sha256) == (len(by[r.conv_id]), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert levels == {0, 1}


def test_a_wrong_mask_would_be_seen(spark):
    out = chat.format_chat(spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "there")], "conv_id long, turn long, role string, text string"))
    moved = out.withColumn("loss", F.transform("loss", lambda s: F.struct(s["start"], s["length"], (s["byte_start"] - 1).alias("byte_start"), s["byte_length"])))
    assert chat.digests(moved).first().loss_sha256 != chat.digests(out).first().loss_sha256


def test_chat_is_native(spark):
    plan = queries.op9_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


# HTML


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title=it's>Hello there, all of you.</p><p>More of it, too.</p>", "Hello there, all of you. More of it, too."),
        ("<div data-x=don't><p>One, two.</p></div><p>Three, four.</p>", "One, two. Three, four."),
        ("<p don't>One, two.</p><p a='x'b=\"y>z\">Three, four.</p>", "One, two. Three, four."),
        ("<p title=\"never closed>One, two.</p><p>Three, four.</p>", "One, two. Three, four."),
        ("<p>a &lt; b, 1 < 2 &amp; </3> c</p><!--><p>no</p>--><p>x, y</p>", "a < b, 1 < 2 & c no --> x, y"),
        ("<a href=x title=a/b>no, </a><p>One, two<br/>three.</p>", "no, One, two three."),
    ],
)
def test_markup_is_read_by_the_standard(page, want):
    assert html.extract(f"<body>{page}") == want


PROSE = "It was a long and quiet morning, with little to do, and the sea lay flat under a pale sky, as it had for days. "


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "with-sidebar", "sidebar-layout", "content-sidebar-wrap", "search-results-page", "related", "no-banner notice"])
def test_a_wrapper_keeps_its_article(wrapper):
    page = f'<body><div class="{wrapper}"><article><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></article></div><div class=sidebar><p>{PROSE}</p></div>'
    assert html.extract(page) == f"Title {PROSE.strip()} {PROSE.strip()}"


def test_words_alone_drop_no_prose_in_an_article():
    blocks = "".join(f'<div class="{c}"><p>{c}: {PROSE * 2}</p></div>' for c in ("share", "notice-period", "related", "search"))
    furniture = '<div class="share-buttons"><a href=a>Share</a> <a href=b>Post</a></div><div class=comments><article class=comment-body><p>' + PROSE * 9 + '</p></article></div><div class="ad">Buy, buy, buy.</div><div id=adBanner>More.</div><p class="cookie-notice">We use cookies.</p>'
    got = html.extract(f"<body><article><h1>Title</h1><p>{PROSE}</p>{blocks}{furniture}<p>{PROSE}</p></article>")
    want = ["Title", PROSE.strip(), *(f"{c}: {(PROSE * 2).strip()}" for c in ("share", "notice-period", "related", "search")), PROSE.strip()]
    assert got == " ".join(want)


class _Article(__import__("html.parser").parser.HTMLParser):
    """The text between <article> and </article>, block by block, read by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("h1", "p", "br"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_give_their_articles(spark):
    import pandas as pd

    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = queries.op4_html(spark, SF).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    hits = out = known = 0
    for page in pages.itertuples():
        reader = _Article()
        reader.feed(page.html or "")
        reader.close()
        want = " ".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x).split()
        found = got.text[page.page_id].split()
        assert got.n_chars[page.page_id] == len(got.text[page.page_id])
        both = __import__("collections").Counter(want) & __import__("collections").Counter(found)
        hits, out, known = hits + both.total(), out + len(found), known + len(want)
    assert hits / out > 0.999 and hits / known > 0.999


# the pipeline's stages


def test_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(41)
    words = lambda n: " ".join(letters(rng, 5) for _ in range(n))
    text, item = words(120), words(30)
    near = text.replace(text.split()[60], "other")
    rows = [(None, None), (1, None), (2, ""), (2, ""), (None, text), (7, near), (None, words(50)), (7, words(40)), (8, item + " end"), (None, words(3)), (9, "z " * 20_000)]
    docs = docs_of(spark, rows)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:9]) for r in df.collect())
    assert key(stage["quality"](spark, docs, str(tmp_path))) == key(docs)
    kept = stage["near_dedup"](spark, docs, str(tmp_path))
    # empty texts are one group, and so are the two near copies, of which the one with an id stays
    assert kept.columns == docs.columns and key(kept) == key(docs_of(spark, [(1, None), (7, near), rows[6], rows[7], rows[8], rows[9], rows[10]]))
    assert key(stage["decontaminate"](spark, docs, str(tmp_path))) == key(docs_of(spark, [r for r in rows if r[0] != 8]))
    assert stage["packing"](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 6
    done = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(done.doc_id.dropna()) == {1, 7, 9} and done.doc_id.isna().sum() == 2


def test_a_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs_of(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# the quality classifier


def test_trees_against_a_plain_walk_and_a_plain_search():
    from tidemark.llm.quality import fit

    rng = np.random.default_rng(42)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = fit(x, y, trees=12, depth=3, bins=500)

    def walk(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        return total

    assert np.allclose(model.raw(x), [walk(r) for r in x]) and ((model.raw(x) > 0) == y).mean() > 0.95
    # the first split is the best of all there are
    p = y.mean()
    grad, hess = p - y, np.full(len(y), p * (1 - p))

    def gain(j, t):
        left = x[:, j] <= t
        if hess[left].sum() < 1 or hess[~left].sum() < 1:
            return 0.0
        return sum(grad[m].sum() ** 2 / (hess[m].sum() + 1) for m in (left, ~left)) - grad.sum() ** 2 / (hess.sum() + 1)

    best = max(gain(j, t) for j in range(4) for t in np.unique(x[:, j]))
    assert gain(model.feature[0][0], model.threshold[0][0]) == pytest.approx(best)


# toxicity


def test_log_odds_are_graded_and_keep_rare_sure_words(spark):
    rows = [("rare", 200, 0), ("sure", 5000, 10), ("likely", 300, 150), ("hapax", 1, 0), ("clean", 10, 5000), ("even", 4000, 4000), ("rest", 90_000, 90_000)]
    got = {r.u: r.s for r in toxicity.log_odds(spark.createDataFrame(rows, "u string, y1 long, y0 long")).collect()}
    assert set(got) == {"rare", "sure", "likely", "clean"}
    assert min(got["sure"], got["rare"]) > 2 > got["likely"] > 0 > got["clean"]


def test_a_word_in_one_of_a_hundred_toxic_documents_is_learned(spark):
    rng = random.Random(43)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    say = lambda *extra: " ".join(rng.sample(plain, 40) + list(extra) + rng.sample(plain, 10))
    rows, labels = [], []
    for i in range(12_000):
        bad = i % 2
        rows.append((i, say(*(["zorvax", "quimble"] if i % 200 == 1 else ["blork", "snarv"] if bad else []))))
        labels.append((i, 1, bad))
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    rare = [r for i, r in got.items() if i % 200 == 1 and r.held_out]
    assert rare and all(r.predicted for r in rare) and sum(r.predicted for i, r in got.items() if i % 2 == 0) < 120


def test_scores_against_all_segments():
    """The score of a text from every maximal segment found by exhaustive search."""
    rng = random.Random(44)
    model = toxicity.Model({f"={c}": v for c, v in zip("abcdef", (3.0, 2.0, 1.2, -1.0, -4.0, 0.7), strict=True)}, -0.5, 0.8, 0.3)
    for _ in range(100):
        words = [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 25))]
        s = [model.odds.get(f"={w}", 0.0) - 0.5 for w in words]
        rest, todo = 1.0, [(0, len(s))]
        while todo:
            a, b = todo.pop()
            best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best and best[0] > 1e-12:
                rest *= 1 - np.exp(-model.rate * len(s) * np.exp(-model.decay * best[0]))
                todo += [(a, best[2]), (best[3], b)]
        assert toxicity.score(model, " ".join(words)) == pytest.approx(1 - rest)


# near copies


def test_every_near_fingerprint_is_a_candidate():
    """Links are within the radius, one for each node of a part, and whoever has a near neighbour is in one."""
    from tidemark.llm.simhash import attached

    rng = random.Random(51)
    width, bits, radius = 40, 4, 4
    fps = [rng.getrandbits(width) for _ in range(60)]
    for _ in range(240):
        x = rng.choice(fps)
        for b in rng.sample(range(width), rng.randrange(0, 6)):
            x ^= 1 << b
        fps.append(x)
    links = set()
    for prefix in range(1 << bits):
        near = [i for i, x in enumerate(fps) if bin((x >> (width - bits)) ^ prefix).count("1") <= radius // 2]
        a, b, _ = attached(np.array([fps[i] for i in near], np.uint64), np.array(near, np.int64), prefix, bits, radius, width)
        assert len(set(a.tolist())) == len(a) and not (a == b).any()
        links |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert all(bin(fps[a] ^ fps[b]).count("1") <= radius for a, b in links)
    linked = {x for pair in links for x in pair}
    for i, x in enumerate(fps):
        if any(j != i and bin(x ^ y).count("1") <= radius for j, y in enumerate(fps)):
            assert i in linked


def test_a_centre_is_everyones_candidate():
    """The text that all others are copies of is linked to all of them that it meets."""
    from tidemark.llm.simhash import attached

    rng = random.Random(54)
    width, radius = 40, 4
    base = rng.getrandbits(width)
    fps = [base] + [base ^ sum(1 << b for b in rng.sample(range(width), 4)) for _ in range(80)]
    nodes = np.array([1000, *range(80)])
    a, b, d = attached(np.array(fps, np.uint64), nodes, 0, 0, radius, width)
    assert set(a.tolist()) == set(range(80)) and set(b.tolist()) == {1000} and set(d.tolist()) == {4}


def test_candidates_across_roots():
    """Every node with a near one of another root gets such a partner, whatever the order."""
    from tidemark.llm.simhash import across

    rng = random.Random(53)
    width, bits, radius = 40, 4, 4
    base = [rng.getrandbits(width) for _ in range(8)]
    fps = [rng.choice(base) ^ (1 << rng.randrange(width)) for _ in range(120)]
    roots = [rng.randrange(5) for _ in fps]
    drawn = set()
    for seed in (1, 2, 3):
        links = set()
        for prefix in range(1 << bits):
            near = [i for i, x in enumerate(fps) if bin((x >> (width - bits)) ^ prefix).count("1") <= radius // 2]
            a, b, _ = across(np.array([fps[i] for i in near], np.uint64), np.array(near), np.array([roots[i] for i in near]), seed, prefix, bits, radius, width)
            links |= set(zip(a.tolist(), b.tolist(), strict=True))
        assert all(roots[a] != roots[b] and bin(fps[a] ^ fps[b]).count("1") <= radius for a, b in links)
        stands = {(fps[i], roots[i]): min(j for j in range(len(fps)) if (fps[j], roots[j]) == (fps[i], roots[i])) for i in range(len(fps))}
        for i in stands.values():
            if any(roots[i] != roots[j] and bin(fps[i] ^ fps[j]).count("1") <= radius for j in range(len(fps))):
                assert any(i == a for a, _ in links)
        drawn.add(frozenset(links))
    assert len(drawn) == 3


def test_a_large_group_has_few_candidates(spark):
    from tidemark.llm import simhash

    rng = random.Random(52)
    word = lambda: letters(rng, 5)
    base = [word() for _ in range(150)]
    rows = []
    for i in range(1500):
        x = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 3)):
            x[at] = word()
        rows.append((i, " ".join(x)))
    rows += [(5000 + i, " ".join(word() for _ in range(150))) for i in range(300)]
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in rows]
    nodes = spark.createDataFrame([(k, simhash.table_fingerprints(x, 40, 16).view(np.int64).tolist()) for k, x in enumerate(sets)], "node long, fps array<long>").repartition(3)
    pairs = simhash.candidates(nodes, len(rows), 40, 16, 4).collect()
    assert all(p.a > p.b for p in pairs) and len(pairs) < 16 * len(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_copies(docs_of(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(1500)) and all(got[5000 + i] == 5000 + i for i in range(300))


def copies_of_every_degree(rng, copies, most):
    """One text of 150 words and copies of it with up to ``most`` words changed, many of them more like each other than like the text."""
    base = [letters(rng, 5) for _ in range(150)]
    out = [base]
    for _ in range(copies):
        x = list(rng.choice(out)) if rng.random() < 0.5 else list(base)
        for at in rng.sample(range(150), rng.randrange(1, most)):
            x[at] = letters(rng, 5)
        out.append(x)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def met_pairs(fps, radius=4):
    """All pairs of which one of the tables' fingerprints is within the radius."""
    fps = np.stack(fps)
    return {(a, b) for b in range(len(fps)) for a in np.flatnonzero((np.bitwise_count(fps[:b] ^ fps[b]) <= radius).any(axis=1)).tolist()}


def test_no_pair_is_hidden_by_a_central_one(spark):
    """What meets and is alike is in one component, however many others are nearer to the most central text."""
    from tidemark.llm import simhash

    rows = copies_of_every_degree(random.Random(56), 700, 16)
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in met_pairs([simhash.table_fingerprints(x, 40, 16) for x in sets]):
        if simhash.alike(sets[a], sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(rows))}
    assert 100 < len(set(want.values())) < len(rows) - 100
    assert {r.doc_id: r.component_id for r in simhash.similar_copies(docs_of(spark, rows).repartition(3)).collect()} == want


def test_pairs_are_listed_or_both_crowded(spark):
    """Every pair that meets is listed, unless both of its nodes are told to be crowded; equal fingerprints are no exception."""
    from tidemark.llm import simhash

    rng = random.Random(57)
    rows = copies_of_every_degree(rng, 60, 8) + [(0, " ".join(letters(rng, 5) for _ in range(80))) for _ in range(40)]
    fps = [simhash.table_fingerprints(simhash.shingle_set(t.encode(), 5), 40, 16) for _, t in rows]
    fps += [fps[-1]] * 2 + [fps[-2]] * 12
    nodes = spark.createDataFrame([(k, x.view(np.int64).tolist()) for k, x in enumerate(fps)], "node long, fps array<long>").repartition(3)
    found = simhash._met(nodes, len(fps), 40, 16, 4).collect()
    listed, crowd = {(min(r.a, r.b), max(r.a, r.b)) for r in found if r.a != r.b}, {r.a for r in found if r.a == r.b}
    met = met_pairs(fps)
    assert listed <= met and crowd and 20 < len({x for p in met for x in p} - crowd)
    assert all(p in listed or crowd.issuperset(p) for p in met)
    assert {len(fps) - 14, len(fps) - 13} <= {x for p in listed for x in p} - crowd


def test_all_pairs_of_different_roots(monkeypatch):
    """Among crowded nodes every pair of different roots that meets is told of, in the first table where it does, however few are held at a time."""
    from tidemark.llm import simhash

    rng = random.Random(58)
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in copies_of_every_degree(rng, 120, 6)]
    fps = [simhash.table_fingerprints(x, 40, 16) for x in sets]
    roots, sizes, bits = np.array([rng.randrange(4) for _ in sets]), np.array([len(x) for x in sets]), 2
    for held in (3, 1_000_000):
        monkeypatch.setattr(simhash, "PAIRS", held)
        got = defaultdict(set)
        for table, prefix in itertools.product(range(16), range(1 << bits)):
            near = [i for i, x in enumerate(fps) if bin((int(x[table]) >> (40 - bits)) ^ prefix).count("1") <= 2]
            for x, y in simhash.crossing(np.stack([fps[i] for i in near]), roots[near], sizes[near], table, prefix, bits, 4, 40):
                for a, b in zip(x.tolist(), y.tolist(), strict=True):
                    got[near[a], near[b]].add(table)
        apart = {p: np.bitwise_count(fps[p[0]] ^ fps[p[1]]) for p in met_pairs(fps) if roots[p[0]] != roots[p[1]]}
        want = {p: {int(np.flatnonzero(d <= 4)[0])} for p, d in apart.items() if d.sum() <= int(simhash.MOST_APART * 640)}
        assert len(want) > 500 and got == want


# SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda frame: sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
