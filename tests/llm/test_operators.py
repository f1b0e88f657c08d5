"""Every operator against brute force on small fixtures, with the awkward rows of each contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from terravox.llm import anchors, automata_dedup, decontaminate, html_text, id_store, language, packing, quality, simhash, suffix_merge, vector_links
from terravox.llm.queries import tokenizer

DOCS = "doc_id long, text string, id string, row string, bucket int"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, shared passages, repeated words, long and empty texts, a repeated row, null texts and ids."""
    passage = prose(1, 120)
    rows = [(i, prose(100 + i, 30 + 7 * i)) for i in range(12)]
    rows += [(20 + i, f"{prose(200 + i, 20)} {passage} {prose(300 + i, 20)}") for i in range(8)]
    rows += [(30 + i, f"{prose(400 + i, 5)} {' '.join(passage.split()[i:])}") for i in range(6)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, None), (43, ""), (44, "the " * 300), (45, "the " * 200 + "end"), (46, "a"), (47, prose(9, 4000)), (48, prose(9, 4000) + " more")]
    rows += [(50, "é ü ß\n\n x \t<|endoftext|> ‘q’"), (None, rows[5][1]), (None, "alone and without a name"), (46, "a"), (-3, rows[7][1][10:])]
    return rows


def brute_dedup(rows, split, join):
    order = [(2**63 - 1 if i is None else i, split((t or "").encode())) for i, t in rows]
    first = {}
    for i, u in order:
        for k in range(len(u) - 49):
            w = tuple(u[k : k + 50])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, u in order:
        hit = np.zeros(len(u), bool)
        for k in range(len(u) - 49):
            if first[tuple(u[k : k + 50])] < i:
                hit[k : k + 50] = True
        spans = int((hit & ~np.r_[False, hit[:-1]]).sum()) if len(u) else 0
        out.append((None if i == 2**63 - 1 else i, len(u), int(hit.sum()), spans, hashlib.sha256(join(u, ~hit)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("small_blocks", [False, True])
def test_substring_dedup(spark, corpus, words, small_blocks, monkeypatch):
    if small_blocks and words:
        monkeypatch.setattr(automata_dedup, "SHARD_WORDS", 60)
    op, split, join = (automata_dedup.passage_dedup, bytes.split, lambda u, k: b" ".join(x for x, y in zip(u, k) if y)) if words else (suffix_merge.substring_dedup, lambda b: b, lambda u, k: bytes(x for x, y in zip(u, k) if y))
    docs = frame(spark, corpus)
    got = op(docs.repartition(7) if small_blocks else docs, keep_text=True).collect()
    assert sorted([tuple(r)[0:1] + tuple(r)[2:6] for r in got], key=str) == brute_dedup(corpus, split, join)


def test_short_runs_lose_no_window(spark, corpus, monkeypatch):
    """Runs of thirty windows: segments, and the longest of them, are cut, and what is in different runs still meets."""
    monkeypatch.setattr(suffix_merge, "RUN_WINDOWS", 30)
    blocks = [(n, anchors.Block(np.array([i for i, _ in part]), np.zeros(len(part), np.int64), [t for _, t in part], False), []) for n, part in enumerate(([(1, b"x" * 400), (2, b"ab" * 90)], [(3, b"x" * 300), (4, bytes(range(120))), (5, b"y" + b"ab" * 40)]))]
    monkeypatch.setattr(suffix_merge, "statuses", lambda block, status, buckets: (seg := anchors.segments(block), np.full(len(seg.row), anchors.COMPARE)))
    runs = list(suffix_merge._runs(blocks, 1))
    assert len(runs) > 10 and all(len(suffix_merge.unzip(r.column("rows")[0].as_py(), "<u4")) <= 30 for r in runs)
    found = set()
    for row in suffix_merge._combine(pa.Table.from_batches(runs)).to_pylist():
        found |= {(row["block"], int(r), int(s)) for r, s in zip(suffix_merge.unzip(row["rows"], "<u4"), suffix_merge.unzip(row["starts"], "<u4"))}
    assert found == {(1, 0, s) for s in range(251)} | {(1, 2, s) for s in range(1, 32)}


def test_very_long_texts_are_sorted_in_bounded_memory(monkeypatch):
    """Two texts of four million equal bytes: a run's memory does not grow with its text's windows."""
    import tracemalloc

    blocks = [(n, anchors.Block(np.array([n]), np.zeros(1, np.int64), [b"x" * 4_000_000], False), []) for n in range(2)]
    monkeypatch.setattr(suffix_merge, "statuses", lambda block, status, buckets: (anchors.Segments(np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(block.texts[0]) - 49])), np.full(1, anchors.COMPARE)))
    tracemalloc.start()
    n = sum(len(suffix_merge.unzip(r, "<u4")) for batch in suffix_merge._runs(iter(blocks), 1) for r in batch.column("rows").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * (4_000_000 - 49) and peak < 500e6


@pytest.mark.parametrize("words", [False, True])
def test_crowded_anchors_lose_no_window(spark, corpus, words):
    """Windows of anchors with many texts are dealt to several tasks, with the same result."""
    n = 60 if words else 9
    rows = corpus + [(600 + i, f"{prose(7, n)} {prose(700 + i // 2, 12)} {prose(8, n)}") for i in range(60)]
    if words:
        got, split, join = automata_dedup.passage_dedup(frame(spark, rows), crowd=2), bytes.split, lambda u, k: b" ".join(x for x, y in zip(u, k) if y)
    else:
        got, split, join = suffix_merge.substring_dedup(frame(spark, rows), crowd=2), lambda b: b, lambda u, k: bytes(x for x, y in zip(u, k) if y)
    assert sorted([tuple(r)[0:1] + tuple(r)[2:6] for r in got.collect()], key=str) == brute_dedup(rows, split, join)


def test_shards_of_matches_agree(monkeypatch):
    """Cutting the reference into shards changes nothing."""
    r = random.Random(5)
    base = [r.randrange(9) for _ in range(400)]
    runs = sorted((r.randrange(20), base[a : a + r.randrange(50, 120)]) for a in (r.randrange(270) for _ in range(60)))
    whole = automata_dedup._matches(runs)
    monkeypatch.setattr(automata_dedup, "SHARD_WORDS", 100)
    assert automata_dedup._matches(runs) == whole
    seen = {}
    for i, w in runs:
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), []).append(i)
    assert whole == [[k for k in range(len(w) - 49) if min(seen[tuple(w[k : k + 50])]) < i] for i, w in runs]


@pytest.mark.parametrize("seed", range(40))
def test_shards_end_between_ids(seed, monkeypatch):
    """A passage that stands twice in its first document stays there, whatever the size of the shards."""
    r = random.Random(seed)
    base = [r.randrange(9) for _ in range(400)]
    runs = sorted((r.randrange(6), base[a : a + r.randrange(50, 120)]) for a in (r.randrange(270) for _ in range(40)))
    passage = [100 + k for k in range(60)]
    runs = [(-9, [500 + k for k in range(100)]), (-5, passage), (-5, passage), (-1, passage), *runs]
    seen = {}
    for i, w in runs:
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), []).append(i)
    want = [[k for k in range(len(w) - 49) if min(seen[tuple(w[k : k + 50])]) < i] for i, w in runs]
    for words in (60, 100, 300, 50_000):
        monkeypatch.setattr(automata_dedup, "SHARD_WORDS", words)
        assert automata_dedup._matches(runs) == want


@pytest.mark.parametrize("n_runs", [1, 2, 3, 5, 17, 64])
def test_merge_never_loses_order(n_runs):
    r = random.Random(3)
    runs, every = [], []
    for _ in range(n_runs):
        mine = sorted(bytes(r.choice(b"ab") for _ in range(50)) if r.random() < 0.5 else (b"ab" * 25)[r.randrange(2) :][:49] + b"z" for _ in range(r.randrange(0, 40)))
        every += mine
        shared, tails, last = [], b"", b""
        for s in mine:
            n = next((i for i in range(50) if i >= len(last) or s[i] != last[i]), 50)
            shared.append(n)
            tails += s[n:]
            last = s
        runs.append((mine, suffix_merge.Run(bytes(shared), tails)))
    got, last = [], b""
    for k, i, same in suffix_merge.merge([x for _, x in runs]):
        s = runs[k][0][i]
        assert same == (s == last)
        got.append(s)
        last = s
    assert got == sorted(every)


def test_pipeline_form_of_suffix_dedup(spark, corpus):
    out = suffix_merge.deduplicated(frame(spark, corpus))
    assert out.columns == ["doc_id", "text", "id", "row", "bucket"]
    kept = out.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in kept} >= {3, 44, 47, 42, 43}
    assert not {40, 41} & {r["doc_id"] for r in kept}
    assert next(r["count"] for r in kept if r["doc_id"] == 46) == 2


def test_simhash_components(spark, corpus):
    near = [(100 + i, corpus[11][1].replace("w1", f"v{i}", 1)) for i in range(5)]
    rows = corpus + near
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        prints.append((2**63 - 1 if i is None else i, sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))))
    root = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if bin(prints[a][1] ^ prints[b][1]).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b], key=lambda k: prints[k][0])
    none = lambda i: None if i == 2**63 - 1 else i
    want = sorted(((none(i), f"{p:016x}", none(prints[root[k]][0])) for k, (i, p) in enumerate(prints)), key=str)
    assert sorted(((r["id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    kept = simhash.deduplicated(frame(spark, rows))
    assert kept.count() == len({(p[2], p[1] if p[2] is None else "") for p in want})


@pytest.mark.parametrize("crowd", [2, 4096])
def test_crowded_keys_lose_no_link(spark, crowd):
    r = random.Random(7)
    bases = [r.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 5))) for b in bases for _ in range(15)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd=crowd).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in links:
        assert bin((e["src"] ^ e["dst"]) & (2**64 - 1)).count("1") <= 4
        root[find(e["src"])] = find(e["dst"])
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                assert find(signed[a]) == find(signed[b])


def test_decontamination(spark, corpus):
    items = [("b1", " ".join(corpus[2][1].split()[3:25])), ("b2", "Short  item"), ("b3", None), ("b2", "!!"), (None, corpus[4][1]), ("b4", corpus[2][1])]
    rows = corpus + [(70, "x short, ITEM! y z u v"), (71, "short")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = {}
    for name, text in items:
        w = word.findall((text or "").translate(low))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update({name} - {None})
    want = []
    for i, text in rows:
        w = word.findall((text or "").translate(low))
        hit, names = np.zeros(len(w), bool), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = True
                    names |= found
        want.append((i, len(w), int(hit.sum()), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit.any())))
    for shard_words in (500_000, 40):
        got = decontaminate.report(decontaminate.hits(frame(spark, rows), bench, shard_words=shard_words)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clean = decontaminate.decontaminated(frame(spark, rows), bench)
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert left[70] == "x y z u v" and 2 not in left and left[5] == rows[5][1]
    assert decontaminate.hits(frame(spark, rows), bench.limit(0)).filter(F.size("hits") > 0).count() == 0


def test_pipeline_forms_with_clashing_names(spark, corpus):
    """Columns of the names that the operators would use come back as they were; ties have a defined result."""
    docs = frame(spark, corpus).selectExpr("doc_id", "text", "'a' AS tv_id", "'b' AS TV_ROW", "'c' AS tv_text", "'d' AS tv_key", "'e' AS tv_dropped", "'f' AS tv_tie")
    bench = spark.createDataFrame([("b", corpus[2][1])], "item_id string, text string")
    for out in (suffix_merge.deduplicated(docs), decontaminate.decontaminated(docs, bench), simhash.deduplicated(docs)):
        assert out.columns == docs.columns
        assert {tuple(r)[2:] for r in out.collect()} == {tuple("abcdef")}
    tied = spark.createDataFrame([(1, "one two three", k) for k in "xyzw"], "doc_id long, text string, more string")
    first = simhash.deduplicated(tied).collect()
    assert len(first) == 1 and first == simhash.deduplicated(tied.orderBy(F.desc("more")).repartition(3)).collect()


def test_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + 0.09 * r.normal(size=16)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [1.0] * 3), (2005, []), (2006, [1e300] + [0.0] * 15), (None, rows[5][1]), (2007, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, node int, list int")
    good = [(k, i, np.array(v)) for k, (i, v) in enumerate(rows) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v / np.abs(v).max() for _, _, v in good])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(good))
    for _ in good:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(good))])
        if (new == label).all():
            break
        label = new
    ids = np.array([2**62 if i is None else i for _, i, _ in good])
    want = {}
    for k, (at, _, _) in enumerate(good):
        want[at] = (int(near[k].sum()), int(ids[label == label[k]].min()))
    for lists, margin in ((None, 1.0), (9, 1.0), (None, 0.6)):
        got = vector_links.near_vectors(df, lists=lists, margin=margin).collect()
        assert len(got) == len(rows)
        have = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["id"] is not None}
        right = 0
        for at, (i, _) in enumerate(rows):
            if i is None:
                continue
            links, component = want.get(at, (0, i))
            right += have[i] == (links, component, i == component)
        assert right >= (len(rows) - 1 if margin == 1 else 0.99 * (len(rows) - 1))


def test_vectors_of_each_dimension_lose_no_link(spark):
    """Groups that drift along one direction, several dimensions in one table: the default equals brute force."""
    r = np.random.default_rng(4)
    rows = []
    for dim, n in ((8, 300), (64, 500), (3, 40)):
        start, way = r.normal(size=dim), r.normal(size=dim)
        drift = start / np.linalg.norm(start) + np.linspace(-2, 2, n)[:, None] * way / np.linalg.norm(way) + 0.1 / np.sqrt(dim) * r.normal(size=(n, dim))
        other = r.normal(size=(n, dim))
        rows += [v.astype("f4" if dim == 64 else "f8").tolist() for v in np.concatenate([drift, other])]
    got = vector_links.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>"))
    want = {}
    for dim in {len(v) for v in rows}:
        ids = [i for i, v in enumerate(rows) if len(v) == dim]
        x = np.array([rows[i] for i in ids])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.95
        label = np.arange(len(ids))
        while True:
            new = np.array([label[near[k]].min() for k in range(len(ids))])
            if (new == label).all():
                break
            label = new
        want |= {i: (int(near[k].sum()) - 1, ids[label[k]], label[k] == k) for k, i in enumerate(ids)}
    assert {x["id"]: (x["n_links"], x["component_id"], x["kept"]) for x in got.collect()} == want


def test_vectors_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vector_links.near_vectors(empty).count() == 0
    assert vector_links.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).collect() == [(1, 0, 1, True)]


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = []
    for i, t in corpus:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 256)):
            part = ids[start : start + 256]
            want.append((i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.best_fit(frame(spark, corpus), tokenizer("word_bpe_49k.json"), capacity=256).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1])
        assert sum(n for _, n in parts) <= 256
    assert len(bins) <= 1.03 * -(-sum(w[3] for w in want) // 256)
    assert packing.best_fit(frame(spark, []), tokenizer("word_bpe_49k.json")).count() == 0


def test_fullest_bin_is_fullest():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randrange(1, 40) for _ in range(8)]
        counts = np.bincount(sizes, minlength=61)
        used = packing.fullest(counts, max(sizes), 60)
        assert all(n <= counts[length] for length, n in used.items())
        rest = sorted(sizes)[:-1]
        best = max(s for s in (max(sizes) + sum(x for k, x in enumerate(rest) if m >> k & 1) for m in range(128)) if s <= 60)
        assert sum(length * n for length, n in used.items()) == best


def test_id_store(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    path = id_store.write_store(frame(spark, corpus), tokenizer("byte_bpe_50k.json"))
    got = id_store.read_store(spark, path, keep_ids=True).orderBy("start").collect()
    keys = [2**63 if r["id"] is None else r["id"] for r in got]
    assert keys == sorted(keys) and len(got) == len(corpus)
    want = sorted(((i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in corpus), key=str)
    assert sorted(((r["id"], r["ids"]) for r in got), key=str) == want
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    by = dict(want)
    assert id_store.lookup(spark, path, [3, 47, 999]) == {3: by[3], 47: by[47]}
    empty = id_store.write_store(frame(spark, []), tokenizer("byte_bpe_50k.json"))
    assert id_store.read_store(spark, empty).count() == 0


def test_perfect_hash_has_no_gaps():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    got = id_store.PerfectHash.of(keys)
    assert sorted(got.slots(keys).tolist()) == list(range(len(keys)))


def test_keyed_access_reads_little(spark):
    """One key costs the header, some blocks, a slot and its own ids, whatever the size of the shard."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("number "), F.col("id").cast("string")).alias("text")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        path = id_store.write_store(docs, tokenizer("byte_bpe_50k.json"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    (row,) = id_store.shards(spark, path).collect()
    for key in (0, 7, 19_999):
        with id_store.Shard(path, row["shard"], row["width"]) as shard:
            (offset,), (length,) = shard.ranges(np.array([key]))
            shard.read(int(offset), int(length))
            assert length > 0 and shard.touched < 8 * id_store.HEADER + 20 * 72 + 20 + 4 * length
    with id_store.Shard(path, row["shard"], row["width"]) as shard:
        assert shard.ranges(np.array([-5]))[1].tolist() == [-1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    from terravox.llm.token_ids import IdEncoder

    tok = Tokenizer.from_file(tokenizer(name))
    r = random.Random(4)
    bits = ["hello", " ", "  ", "\n", "\t", "World's", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "é", "e\u0301", "ß", "日本", "1234", "a.b", "!?", "\u00a0", "-", "x" * 40, "it's", "'ll", "\r\n", "<|", "|>"]
    for plain in (False, True):
        enc = IdEncoder(tokenizer(name), plain=plain)
        tok.encode_special_tokens = plain
        for _ in range(400):
            text = "".join(r.choice(bits) + r.choice(["", "", " "]) for _ in range(r.randrange(0, 12)))
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_quality_and_language_hold_out(spark):
    """Accuracy on held-out rows, and that all rows get a score."""
    from terravox.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    found = queries.op1_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.95
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = queries.op2_language_id(spark, sf).join(langs, "doc_id").filter("held_out AND lang IS NOT NULL").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


@pytest.mark.parametrize("text", ["ab12 " * 3000, "a1" * 4096, "a " + "1 " * 6000, "é9-" * 120_000, "abc d. 1"])
def test_quality_counts_every_letter(text):
    """Periodic texts of any length have the letter share of the whole text."""
    share = sum(c.isalpha() for c in text) / len(text)
    ratios = quality.features(text)[quality.WORDS + quality.SHAPES + quality.PAIRS :]
    assert ratios[4] == pytest.approx(share, abs=1e-6) and ratios[5] == pytest.approx(1 - share, abs=1e-6)


def test_classifiers_with_awkward_rows(spark, corpus):
    docs = frame(spark, corpus)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (5, None), (999, 1)], "doc_id long, quality int")
    out = quality.scores(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(corpus) and all(0 <= r["score"] <= 1 for r in out)
    none = quality.scores(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.0}
    model = language.fit(docs.withColumn("lang", F.when(F.col("doc_id") < 12, F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))))
    said = language.predict(docs, model).collect()
    assert {r["lang_pred"] for r in said if r["id"] in (42, 43)} == {"und"} and len(said) == len(corpus)
    assert {r["lang_pred"] for r in language.predict(docs, model, least=1.1).collect()} == {"und"}
    empty = frame(spark, [])
    assert language.predict(empty, language.fit(empty.withColumn("lang", F.lit(None).cast("string")))).count() == 0
    assert quality.scores(empty, quality.fit(empty, labels)).count() == 0


def test_labels_without_documents_are_not_chosen(spark, corpus):
    """The bound of the sample counts documents, not labels; a repeated id does not exceed it."""
    docs = frame(spark, corpus[:12] + [corpus[3]] * 50)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(1000 + i, i % 2) for i in range(3000)], "doc_id long, quality int")
    x, label, shares = quality.labelled(docs, labels, per_class=5)
    assert len(x) == 10 and sorted(label.tolist()) == [0] * 5 + [1] * 5 and shares == {0: 6, 1: 6}


def test_votes_equal_brute_force(spark, corpus):
    """Scores by the operator's blocks equal votes counted one text at a time, in plain loops."""
    docs = frame(spark, corpus)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(20, 1), (21, 0), (47, 0)], "doc_id long, quality int")
    voters = quality.fit(docs, labels)
    known = voters.value
    got = sorted((str(r["id"]), round(r["score"], 5)) for r in quality.scores(docs, voters, neighbours=5).collect())
    want = []
    for i, t in corpus:
        z = known.latent(quality.features(t or "")[None, :])[0].astype(float)
        cosine = [(-float(z @ v.astype(float)), k) for k, v in enumerate(known.vectors)]
        votes = [0.0, 0.0]
        for c, k in sorted(cosine)[:5]:
            votes[known.label[k]] += max(-c, 0) ** 2 * known.weight[known.label[k]]
        want.append((str(i), round(votes[1] / sum(votes), 5) if sum(votes) else 0.0))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert np.allclose([s for _, s in got], [s for _, s in sorted(want)], atol=1e-3)


def test_language_sample_is_bounded(spark):
    """One id repeated thousands of times and many languages stay within the documented rows."""
    rows = [(1, f"copy {prose(1, 5)}", "aa")] * 3000 + [(i, prose(i, 8), "aa") for i in range(2, 60)] + [(100 + i, prose(i, 5), f"l{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    made, language_model = language.Model, language.Model.__init__

    def spy(self, x, names, seed=0):
        seen.append(list(names))
        language_model(self, x, names, seed)

    made.__init__ = spy
    try:
        language.fit(docs, per_language=20)
        language.fit(docs, per_language=20, most_rows=62)
    finally:
        made.__init__ = language_model
    assert seen[0].count("aa") == 20 and len(seen[0]) == 50
    assert seen[1].count("aa") == 2 and len(seen[1]) == 32


def test_language_equals_brute_force(spark, corpus):
    """Counts equal a plain enumeration of n-grams; predictions equal the averaged embeddings times the softmax layer."""
    def grams(text):
        marked = f" {' '.join(text.lower().split())} "
        for a in range(len(marked)):
            for n in range(1, 5):
                g = marked[a : a + n]
                if len(g) == n and " " not in g[1:-1] and g != " " and not (n == 2 and g == "  "):
                    yield g

    for _, t in corpus[:20] + [(0, "É ü"), (0, "a")]:
        assert language.counts(t).sum() == sum(1 for _ in grams(t))
    docs = frame(spark, corpus).withColumn("lang", F.when(F.col("doc_id") < 12, F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    model = language.fit(docs)
    known = model.value
    for r in language.predict(docs, model).collect():
        texts = [t for i, t in corpus if i == r["id"] and t]
        if r["id"] in (3, 47):
            p = known._softmax((language.shares(texts[0])[None, :] @ known.table + known.bias) / known.temperature)[0]
            assert r["lang_pred"] == known.languages[int(p.argmax())] and r["score"] == pytest.approx(float(p.max()), abs=1e-5)
            assert r["accepted"] == (r["score"] >= known.threshold(0.99))


PAGES = [
    ("<p>One &amp; two<br>three</p><script>var a='</p>';</script><nav>menu</nav>", "One & two three"),
    ("<body><div class='ad'>buy</div><article><h1>T</h1><p>a<b>b</b>c<p>d\n  e<aside>x</aside></article><footer>f</footer>", "T abc d e"),
    ("<article><p>text</p><section id=comments><p>rude</p></section></article>", "text"),
    ("<!-- <p>no</p> --><p>yes<!-- a", "yes"),
    ("plain &lt;b&gt; &eacute;", "plain <b> é"),
    ("<ul><li>a<li>b</ul><form><p>x</p></form><table><tr><td>c<td>d</table>", "a b c d"),
    ("<p title=\"a>b\">q</p><style>p{}</style><textarea>z</textarea>", "q"),
    ("<div><p>unclosed <i>it", "unclosed it"),
    ("", ""),
    (None, ""),
    ("<", "<"),
    ("<p>" * 3000 + "deep", "deep"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/a", h, 1) for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>", 2)], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    assert {k: got[k]["text"] for k in range(len(PAGES))} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert got[None]["text"] == "x" and all(r["n_chars"] == len(r["text"]) for r in got.values())


HOSTILE = {"nested": "<div>", "paragraphs": "<p>", "open quotes": '<a "', "quotes and ends": '<a "> "', "signs": "<", "list items": "<li><div>", "cells": "<table><td>", "strays": "<b></i>", "buttons": "<p><button><div>", "comments": "<!--", "scripts": "<script>", "spaces": "<a \t"}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    """A page of one megabyte, and twice that takes about twice the time."""
    import time

    def took(n):
        began = time.process_time()
        html_text.walk(HOSTILE[name] * (n // len(HOSTILE[name])), close=lambda node: None)
        return time.process_time() - began

    took(1000)
    assert took(1_000_000) < 30 and took(1_000_000) < 6 * took(500_000) + 0.5


@pytest.mark.parametrize("few", [500_000, -1])
def test_site_tree_removes_what_a_host_repeats(spark, few, monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_PATHS", few)
    pages = [(i, f"https://s.org/{i}", f"<div><div><span>Home</span> <span>About</span></div><div id=c><p>{prose(i, 20)}</p></div><div id=z>Legal notice of s.org</div></div>") for i in range(20)]
    out = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: prose(i, 20) for i in range(20)}


def test_site_tree_decides_inside_main(spark):
    """Boxes a host repeats in main go; text beside a teaser, headers of the article and texts put up often stay."""
    box = lambda i: f"<div class=zq><b>Read on</b> every day <i>{i % 2}</i></div><div>Plain box</div>"
    pages = [(i, f"https://a.org/{i}", f"<main><div class=x1>{prose(i, 30)}</div>{box(i)}<p>{prose(100 + i, 30)}</p></main>") for i in range(30)]
    want = {i: f"{prose(i, 30)} {prose(100 + i, 30)}" for i in range(30)}
    pages += [(100 + i, f"https://b.org/{i}", f"<ul><li>Start<li>Shop</ul><article><h2>{prose(i, 3)}</h2></article><div><p>{prose(i, 60)}</p></div><div id=end>Imprint</div>") for i in range(30)]
    want |= {100 + i: f"{prose(i, 3)} {prose(i, 60)}" for i in range(30)}
    pages += [(200 + i, f"https://c.org/{i}", f"<article><div class='post-header'>{prose(i, 5)}</div><p class='share-price'>{prose(i, 40)}</p></article><nav>Home</nav>") for i in range(30)]
    want |= {200 + i: f"{prose(i, 5)} {prose(i, 40)}" for i in range(30)}
    pages += [(300 + i, f"https://d.org/{i}", f"<script>{i}</script><article><p>{prose(i // 20, 40)}</p></article>") for i in range(40)]
    want |= {300 + i: prose(i // 20, 40) for i in range(40)}
    pages += [(400, "https://e.org/", f"<article>{prose(1, 4)}</article><p>{prose(2, 60)}</p>")]
    want |= {400: f"{prose(1, 4)} {prose(2, 60)}"}
    out = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == want


def test_blocks_hold_all_windows():
    texts = [prose(i, 80).encode() for i in range(5)] + [b"", b"short"]
    block = anchors.Block(np.arange(7), np.arange(7), texts, False)
    seg = anchors.segments(block)
    for r, t in enumerate(texts):
        mine = seg.row == r
        assert seg.windows[mine].sum() == max(0, len(t) - 49)


def test_unit_columns_of_mixed_width():
    rng = np.random.default_rng(5)
    raw = [x.astype("<f4" if i % 3 else "<f8").tobytes() for i, x in enumerate(rng.normal(size=(20, 6)))]
    for lo, n in ((0, 20), (4, 9), (1, 1), (7, 0)):
        got = vector_links._unit_column(pa.array(raw, pa.binary()).slice(lo, n), 6)
        assert (got == vector_links._unit(raw[lo : lo + n], 6)).all() and got.shape == (n, 6)


@pytest.mark.parametrize("seed", range(3))
def test_ends_of_words(seed):
    """As the plain pattern says, and in linear time: a megabyte of signs inside one word."""
    r = random.Random(seed)
    plain = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.DOTALL)
    for _ in range(3000):
        word = "".join(r.choice("aé_9.,-\u00b7\u0301\u4e2d") for _ in range(r.randrange(9)))
        assert quality.ends(word) == plain.match(word).groups()
    long = "(a" + "." * 1_000_000 + "b)."
    assert quality.ends(long) == ("(", long[1:-2], ").") and quality.features(f"{long} x {long}").any()
