"""The five stages of the pipeline, as a whole, against plain Python on a small corpus."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from terravox.llm import quality, simhash
from terravox.llm.common import alnum_words, lower_words
from terravox.llm.queries import tokenizer


def corpus():
    """Good prose, junk, exact and near copies, shared passages, benchmark passages, awkward rows."""
    r = random.Random(11)
    vowels, rest = "aeiou", "bcdfglmnprst"
    vocabulary = ["".join(r.choice(rest) + r.choice(vowels) for _ in range(r.randrange(1, 5))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ","]) for _ in range(n)).capitalize()
    junk = lambda n: " ".join("".join(r.choice("ABCXYZ0123456789#$%") for _ in range(r.randrange(3, 14))) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        good = i % 2 == 0
        rows.append((i, prose(r.randrange(60, 160)) if good else junk(r.randrange(40, 90))))
        labels.append((i, int(good), 0))
    passage, items = prose(40), [("i1", prose(25)), ("i2", prose(6)), ("i3", "")]
    rows += [(200 + i, prose(60) + " " + passage + " " + prose(60)) for i in range(5)]
    rows += [(300, rows[0][1]), (301, rows[2][1]), (302, rows[4][1] + " end"), (303, prose(30) + " " + items[0][1] + " " + prose(30)), (304, prose(90) + " " + items[1][1]), (305, items[0][1])]
    rows += [(400, None), (401, ""), (402, prose(4000)), (None, prose(80))]
    return rows, labels, items


def near_classes(rows):
    fp = [simhash.fingerprint(lower_words(t or "")) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fp[a] ^ fp[b]).count("1") <= 4:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k])
    return sorted((min(g, key=lambda row: 2**63 if row[0] is None else row[0]) for g in groups.values()), key=str)


def without_repeats(rows):
    order = sorted(rows, key=lambda row: 2**63 if row[0] is None else row[0])
    seen, out = set(), []
    for i, t in order:
        raw = (t or "").encode()
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                hit[k : k + 50] = True
        seen |= {raw[k : k + 50] for k in range(len(raw) - 49)}
        left = bytes(b for b, h in zip(raw, hit) if not h)
        if left or not raw:
            out.append((i, left.decode("utf-8", "ignore")))
    return sorted(out, key=str)


def test_stages_as_a_whole(spark, tmp_path):
    rows, labels, items = corpus()
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    table = {"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": [len(t or "") for _, t in rows]}
    pq.write_table(pa.table({c: pa.array(v, kinds[c]) for c, v in table.items()}), str(tmp_path / "documents.parquet"))
    pq.write_table(pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "quality", "toxic"), zip(*labels))}), str(tmp_path / "labels.parquet"))
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    text_of = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    stages, states = dict(corpus_pipeline.STAGES), [docs]
    for name in list(stages)[:-1]:
        got = stages[name](spark, states[-1], str(tmp_path))
        assert got.columns == docs.columns
        path = str(tmp_path / name.replace(" ", "-"))
        got.write.parquet(path)
        states.append(spark.read.parquet(path))
    _, scored, distinct, unrepeated, clean = (text_of(s) for s in states)

    # Quality: what the voters' score says; prose stays and junk goes.
    score = quality.scores(docs, quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))).collect()
    assert sorted((r["id"] for r in score if r["score"] >= 0.7), key=str) == sorted((i for i, _ in scored), key=str)
    ids = {i for i, _ in scored}
    assert len(ids & set(range(0, 120, 2))) >= 57 and len(ids & set(range(1, 120, 2))) <= 3
    assert distinct == near_classes(scored) and {300, 301, 302}.isdisjoint(i for i, _ in distinct)
    assert unrepeated == without_repeats(distinct)

    # Decontamination: windows of ten item words, or of all of a short item's, are gone; other rows are as they were.
    windows = {tuple(w[k : k + 10]) if len(w) >= 10 else tuple(w) for w in (alnum_words(t) for _, t in items) for k in range(max(1, len(w) - 9)) if w}
    holds = lambda t: any(tuple(w[k : k + len(x)]) == x for w in [alnum_words(t)] for x in windows for k in range(len(w) - len(x) + 1))
    before, after = dict(unrepeated), dict(clean)
    assert not any(holds(t) for t in after.values()) and 305 not in after
    assert {i for i, t in before.items() if not holds(t)} <= set(after) and all(after[i] == before[i] for i in after if not holds(before[i]))
    assert all(r["n_chars"] == len(r["text"]) for r in states[-1].collect())

    # Packing, through run(): the same documents, every id at its place, no gap and no sequence too long.
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in clean}
    pieces, sequences = {}, {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(pieces) == set(want)
    for i, mine in pieces.items():
        at = 0
        for p in sorted(mine, key=lambda p: p["piece"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(want[i][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(want[i]) and all(p["length"] == 2048 for p in mine if p["piece"] < len(mine) - 1)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(map(len, want.values())) // 2048) + 1
