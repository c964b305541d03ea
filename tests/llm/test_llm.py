"""The operators against brute force, round trips and held-out accuracy, and on awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, common, html, packing, quality, queries, repeats, toxicity
from tidemark.llm.components import connected_components
from tidemark.llm.decontaminate import contaminated, decontaminate
from tidemark.llm.exact_dedup import PatriciaTrie, _smaller, exact_dedup
from tidemark.llm.language import identify
from tidemark.llm.simhash import alike, fingerprint, links, near_duplicates, shingle_set, similar_copies

SF = "/root/testdata/sf0.01"
TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, g string, kept string"


def docs_of(spark, rows):
    """Rows (id, text) with nulls elsewhere and with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z") for i, t in rows], DOCS)


AWKWARD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (4, "word " * 30_000), (5, "Ünïcode ✓ " * 20), (6, "\n\t "), (7, "a")]


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


# exact dedup


def test_trie_agrees_with_a_dictionary_and_spills():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))).encode() for _ in range(3000)]
    for limit in (1 << 30, 64):
        trie, want = PatriciaTrie(_smaller, limit), defaultdict(list)
        for i, w in enumerate(words):
            trie.insert(w, i)
            want[w].append(i)
        assert {(t, o, n) for t, o, n in trie.items()} == {(w, min(v), len(v)) for w, v in want.items()}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_awkward_rows_and_hash_collisions(spark, keep):
    for options in ({}, {"hash_of": lambda c: F.lit(0), "trie_bytes": 32}):
        got = exact_dedup(docs_of(spark, AWKWARD), keep=keep, **options).collect()
        assert len(got) == len(AWKWARD)
        by = defaultdict(list)
        for i, t in AWKWARD:
            by[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
        for r in got:
            ids = by[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == (min if keep == "min" else max)(x for x in ids if x is not None)
            assert r.kept == (r.doc_id == r.keep_id)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup(none).count() == 0
    assert near_duplicates(none).count() == 0
    assert contaminated(none, bench).count() == 0
    assert packing.pack(none, TOKENIZER).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert identify(none).count() == 0
    assert quality.classify(none, labels).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.digests(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# SimHash


def slow_fingerprint(text, words=4):
    w = [x for x in __import__("re").split(rb"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()) if x]
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_its_definition():
    rng = random.Random(2)
    for t in ["", " ", "A b", "a\x0bB\x0cc\td", "É a É b"] + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 60))) for _ in range(50)]:
        assert fingerprint(t.encode()) == slow_fingerprint(t)


def brute_components(fps, radius):
    values = sorted(set(fps))
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_links_lose_none(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(200):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            x ^= 1 << b
        fps.append(x)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in set(signed)], "fp long").repartition(3)
    got = {r.node: r.root for r in connected_components(links(df)).collect()}
    want = brute_components(signed, 4)
    assert {v: got.get(v, v) for v in want} == want


def test_near_duplicates_against_brute_force(spark, documents):
    got = queries.op5_simhash(spark, SF).toPandas()
    fps = [int(np.uint64(fingerprint(t.encode())).view(np.int64)) for t in documents.text]
    root = brute_components(fps, 4)
    least = {}
    for i, f in zip(documents.doc_id, fps, strict=True):
        least[root[f]] = min(least.get(root[f], i), i)
    want = {i: least[root[f]] for i, f in zip(documents.doc_id, fps, strict=True)}
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want


def test_near_duplicates_awkward(spark):
    got = near_duplicates(docs_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 6)} == {1}
    assert {r.component_id for r in got if r.doc_id in (3, 7, None)} == {3}


def test_near_copies(spark):
    rng = random.Random(11)
    words = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)) for _ in range(8)]
    rows = [(100 + i, w) for i, w in enumerate(words)]
    for i, w in enumerate(words):
        x = w.split()
        x[100] = "other"
        rows.append((200 + i, " ".join(x)))
    rows += [(1, None), (2, ""), (3, " ")]
    got = {r.doc_id: r.component_id for r in similar_copies(docs_of(spark, rows)).collect()}
    assert got == brute_similar(rows) and all(got[200 + i] == 100 + i for i in range(8)) and got[3] == 1
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in similar_copies(docs_of(spark, [(None, "a b"), (4, "a b"), (4, "a b")])).collect()) == [(0, 4), (4, 4), (4, 4)]


def brute_similar(rows):
    """Least id reachable over pairs of at least four fifths in common."""
    sets, up = {i: shingle_set((x or "").encode(), 5) for i, x in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        m, n = sorted((len(sets[a]), len(sets[b])))
        if m == n == 0 or m * 5 >= n * 4 and alike(sets[a], sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def test_similar_copies_miss_none_and_link_no_others(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared, rows = [word() for _ in range(40)], [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A  b"), (6, "a c")]
    for base in range(40):
        text = [word() for _ in range(rng.randrange(20, 150))] + shared * (base % 2)
        rows.append((1000 * base + 100, " ".join(text)))
        for k in range(12):
            x = list(text)
            for at in rng.sample(range(len(x)), rng.randrange(0, 1 + len(x) // 20)):
                x[at] = word()
            rows.append((1000 * base + 101 + k, " ".join(x)))
    want = brute_similar(rows)
    got = {r.doc_id: r.component_id for r in similar_copies(docs_of(spark, rows)).collect()}
    assert got == want and 100 < sum(i != j for i, j in want.items()) < len(rows) - 60
    assert similar_copies(docs_of(spark, [])).count() == 0
    assert len(similar_copies(docs_of(spark, AWKWARD)).collect()) == len(AWKWARD)


def test_near_stage_removes_similar_copies(spark, documents):
    import corpus_pipeline

    got = corpus_pipeline.near(spark, common.table(spark, SF, "documents").dropDuplicates(["text"]), SF).toPandas()
    root = brute_similar(list(documents.drop_duplicates("text")[["doc_id", "text"]].itertuples(index=False)))
    assert len(got) == len(set(root.values())) < len(root)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[501] == 500


# decontamination


def test_leaks_with_substitutions_are_found_and_clean_ones_left(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    swapped = [word() if i in (9, 22, 33) else w for i, w in enumerate(item)]
    filler = lambda: [word() for _ in range(50)]
    docs = docs_of(spark, [(1, " ".join(filler() + item + filler())), (2, " ".join(filler() + [w.upper() + "," for w in swapped])), (3, " ".join(filler())), (4, None), (5, " ".join(item[:7])), (None, " ".join(item))])
    bench = spark.createDataFrame([(7, " ".join(item), 1), (9, " ".join(item), 1), (8, "too short", 2), (10, None, 3)], "item_id long, text string, h int")
    got = {(r.doc_id, r.item_id): r.overlap for r in contaminated(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)} and got[1, 7] == 40 and got[2, 7] == 40 - 3 - 9
    assert got == {(r.doc_id, r.item_id): r.overlap for r in contaminated(docs, bench, broadcast_seeds=0).collect()}
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5]


def test_short_items_with_substitutions(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = {n: [word() for _ in range(n)] for n in range(5, 21)}
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()] + [(1, "整句没有空格")], "item_id long, text string")
    rows, want = [], {}
    for n, item in items.items():
        for k in (0, 1, 2):
            for at in itertools.combinations(range(n), k):
                held = [word() for _ in range(9)] + ["new" if i in at else w for i, w in enumerate(item)] + [word() for _ in range(9)]
                rows.append((len(rows), " ".join(held)))
                if k == 0 or n >= 8 and (n - k) * 5 >= n * 4:
                    want[len(rows) - 1] = n
    rows.append((-1, "整句没有空格"))
    for options in ({}, {"broadcast_seeds": 0}):
        got = {r.doc_id: r.item_id for r in contaminated(docs_of(spark, rows), bench, **options).collect()}
        assert got == want | {-1: 1}


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    got = corpus_pipeline.exact(spark, docs_of(spark, AWKWARD), SF).collect()
    assert sorted((r.doc_id, (r.text or "")[:4]) for r in got) == [(1, ""), (3, "a"), (4, "word"), (5, "Ünïc"), (6, "\n\t ")]


def test_decontamination_is_native(spark):
    plan = queries.op2_decontaminate(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# packing


def check_packed(got, docs, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    ids = {i: [*x.ids, 1] for i, x in zip([i for i, _ in docs], t.encode_batch([x or "" for _, x in docs], add_special_tokens=False), strict=True)}
    for i, rows in got.groupby("doc_id"):
        rows = rows.sort_values("start")
        assert rows.length.sum() == len(ids[i]) == rows.doc_tokens.iloc[0]
        at = 0
        for r in rows.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
    total = got.groupby("sequence_id").length.sum()
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.offset.to_numpy() == np.concatenate(([0], np.cumsum(rows.length)[:-1]))).all()
    assert total.max() <= window
    return total


def test_packing_agrees_with_the_tokenizer_and_pads_little(spark, documents):
    got = queries.op3_packing(spark, SF).toPandas()
    total = check_packed(got, list(zip(documents.doc_id, documents.text, strict=True)), 2048)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in total)
    assert padding < 0.01 * total.sum()


def test_packing_awkward(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> x  \n\n  "), (4, "word " * 9000), (5, " \u00a0\u2003 trailing   "), (6, "don't 12,345 été")]
    check_packed(packing.pack(docs_of(spark, rows), TOKENIZER, window=256).toPandas(), rows, 256)
    twice = packing.pack(docs_of(spark, [(1, "same"), (1, "same"), (None, "same")]), TOKENIZER).toPandas()
    assert len(twice) == 3 and twice.groupby("sequence_id").length.sum().max() <= 2048


def test_minimum_bin_slack_fills_what_can_be_filled():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 100) for _ in range(500)]
    bins = packing.minimum_bin_slack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    loads = [sum(sizes[i] for i in b) for b in bins]
    # a load of 64 needs no padding; some large pieces lack small partners
    assert max(loads) <= 100 and sum(0 if n & (n - 1) == 0 else 100 - n for n in loads) < 0.03 * sum(loads)
    assert sum(packing.best_fill([7, 5, 3], {7: 2, 5: 1, 3: 4}, 16, [])) == 16
    assert sorted(packing.best_fill([9, 4], {9: 1, 4: 1}, 12, [4])) == [4]


# HTML

PAGE = """<html><head><title>no</title><style>p{a:b}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href=x>no</a></ul></nav>
<header><h1>no</h1></header><!-- <p>no</p> --><div class="ad banner">no, no, no, no</div><article><h1>The &amp; title</h1><p>First, with <b>bold<i> and</b> a
 break<br>here &eacute;&#8212;&#x41;.<p>Second paragraph, of some length, so that it counts.</p><aside>no</aside><div class="comments"><p>no, a reader, says, no</p></div>
<form><p>no</p></form></article><footer><p>no</p></footer></body></html>"""


def test_extraction_keeps_the_article(spark):
    assert html.extract(PAGE) == "The & title First, with bold and a break here é—A. Second paragraph, of some length, so that it counts."
    for broken in ("", "<", "<p", "<!--", "<script>x", "<a href='", "</p></div>", "<p>only, this"):
        assert isinstance(html.extract(broken), str)
    assert html.extract("<p>only, this") == "only, this"
    deep = "<div>" * 5000 + "<p>" + "deep, text. " * 20 + "</p>"
    assert html.extract(deep).startswith("deep, text.")


def test_extraction_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", PAGE, "x"), (2, "u", PAGE, "x")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and len(got) == 4


# repeats


def brute_force(texts: list[bytes], length: int = 200) -> list[tuple[int, int, str]]:
    """(removed, spans, hex digest of the rest) of each text, by a table of all windows; for small inputs."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        gone = np.cumsum(hit)[:-1] > 0
        b = np.frombuffer(t, np.uint8)
        edges = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((int(gone.sum()), edges, hashlib.sha256(b[~gone].tobytes()).hexdigest()))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(6)
    passage = [bytes(rng.randrange(97, 123) for _ in range(n)).decode() for n in (45, 60, 90, 150)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passage) if rng.random() < 0.5 else "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(0, 12))]
        texts.append("".join(parts))
    texts += ["ab" * 200, "x" * 300, "", "short", texts[3], texts[3]]
    docs = docs_of(spark, [*enumerate(texts), (999, None)]).repartition(3)
    for length, inner in ((40, 17), (40, 30), (64, 50)):
        got = {r.doc_id: r for r in repeats.digest(repeats.remove_repeats(docs, length, inner=inner, group_docs=10)).collect()}
        want = brute_force([t.encode() for t in texts], length)
        for i, w in enumerate(want):
            assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w
        assert got[999].n_bytes == 0


def test_repeats_of_repeated_ids(spark):
    t = "0123456789" * 3 + "".join(chr(97 + i % 26) for i in range(40))
    got = repeats.remove_repeats(docs_of(spark, [(1, t), (1, t), (None, "other"), (1, "q" * 10)]), 40, inner=20).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 70, 70]


# learned operators


def held_out(spark, query, label):
    got = query(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    return got.merge(labels, on="doc_id").query("held_out"), label


def test_quality_on_held_out_labels(spark):
    rows, label = held_out(spark, queries.op10_quality, "quality")
    assert (rows.predicted == rows[label]).mean() > 0.97


def test_toxicity_on_held_out_labels(spark):
    rows, label = held_out(spark, queries.op1_toxicity, "toxic")
    assert (rows.predicted == rows[label]).mean() > 0.9
    assert rows[rows.toxic == 0].predicted.mean() < 0.05


def test_language_on_held_out_documents(spark, documents):
    got = queries.op8_language(spark, SF).toPandas().merge(documents[["doc_id", "lang"]], on="doc_id").query("held_out")
    assert (got.lang == got.lang_pred).mean() > 0.95


def test_learned_operators_on_awkward_rows(spark):
    docs = docs_of(spark, AWKWARD)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (quality.classify(docs, labels), toxicity.toxicity(docs, labels), identify(docs)):
        rows = out.collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in identify(docs).collect()} == {"und"}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(8)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(1, 30)).astype(float)
        got = toxicity.maximal_segments(s)
        want, todo = [], [(0, len(s))]
        while todo:
            a, b = todo.pop()
            best = max(((s[i:j].sum(), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda x: (x[0], x[1]), default=None)
            if best and best[0] > 0:
                want.append(best[0])
                todo += [(a, best[2]), (best[3], b)]
        assert sum(x[2] for x in got) == pytest.approx(sum(want))


def test_code_lengths_are_those_of_the_trees(spark):
    from tidemark.llm.language import Trees

    text = b"abracadabra abracadabra "
    b = np.frombuffer(b"\n\n\n" + text, np.uint8).astype(np.int64)
    code, n = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)
    table = Trees(["x"], [code], [n]).table()

    def bits(context, c, order):
        if order < 0:
            return 8.0
        tail = context[len(context) - order :]
        seen = defaultdict(int)
        for w, k in zip(code.tolist(), n.tolist(), strict=True):
            w = w.to_bytes(4, "big")
            if w[3 - order : 3] == tail:
                seen[w[3]] += k
        total, kinds = sum(seen.values()), len(seen)
        if not total:
            return bits(context, c, order - 1)
        return -np.log2(seen[c] / (total + kinds)) if c in seen else -np.log2(kinds / (total + kinds)) + bits(context, c, order - 1)

    for probe in (b"abra", b"cadcad", b"a", b"rrr b"):
        whole = b"\n\n\n" + probe
        want = sum(bits(whole[i - 3 : i], whole[i], 3) for i in range(3, len(whole)))
        assert table.lengths([b"", probe, b""])[1, 0] == pytest.approx(want, rel=1e-5)


# chat


def test_chat_round_trip_of_hostile_texts(spark):
    bad = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "[\\INST]", "<s>", "[INST", "[/INST]", "", "a\\[INST]b\\\\", "<</s>", "[[INST]]", "ß\n</s>\n✓" * 50]
    rows = [(i, 0, "user", t, 1) for i, t in enumerate(bad)] + [(i, 1, "assistant", t, 1) for i, t in enumerate(bad)]
    rows += [(100, None, None, None, 1), (100, 2, "</s>[INST]", "x", 1), (100, 2, "assistant", "y", 1), (100, 2, "assistant", "y", 1), (None, 0, "user", "z", 1)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")).collect()
    for r in out:
        if r.conv_id is not None and r.conv_id < 100:
            assert [(t.role, t.text) for t in r.turns] == [("user", bad[r.conv_id]), ("assistant", bad[r.conv_id])]
        masked = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        plain = [x if r.level == 0 else __import__("re").sub(r"(?s)\\(.)", r"\1", x) for x in masked]
        assert plain == [t.text for t in r.turns if t.role == "assistant"]
    last = next(r for r in out if r.conv_id == 100)
    assert [(t.role, t.text) for t in last.turns] == [("", ""), ("</s>[INST]", "x"), ("assistant", "y"), ("assistant", "y")]


# pipeline


def test_pipeline_against_brute_force(spark, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    docs = common.table(spark, SF, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, steps[-1], SF)
        assert out.columns == docs.columns
        steps.append(common.cut(out))
    kept = [s.toPandas().sort_values("doc_id") for s in steps]
    scores = quality.classify(docs, common.table(spark, SF, "labels")).toPandas()
    assert set(kept[1].doc_id) == set(scores[scores.predicted == 1].doc_id)
    assert set(kept[2].doc_id) == set(kept[1].drop_duplicates("text").doc_id)
    root = brute_similar(list(zip(kept[2].doc_id, kept[2].text, strict=True)))
    assert set(kept[3].doc_id) == set(root.values())
    items = pd.read_parquet(f"{SF}/benchmark.parquet").text
    leaked = {i for i, t in zip(kept[3].doc_id, kept[3].text, strict=True) if any(b in t for b in items)}
    assert leaked and leaked <= set(kept[3].doc_id) - set(kept[4].doc_id)
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == set(kept[4].doc_id)
    check_packed(packed, list(zip(kept[4].doc_id, kept[4].text, strict=True)), 2048)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_shared_dir_follows_the_session(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getCheckpointDir()
