"""The pipeline against a plain version in Python, stage by stage, and as a whole."""

import base64
import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
import public_tokenizers

from lorekeep.llm import bpe, common, lines, mixing, quality, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def good(rows, model):
    buckets = quality.Buckets()
    return [r for r in rows if model.scores(np.stack([quality.features((r["text"] or "").encode(), buckets)]).astype(float))[0] >= quality.THRESHOLD]


def without_repeats(rows):
    seen, last = defaultdict(set), {}
    key = lambda x: x.strip(WHITE).translate(LOWER)
    for n, r in enumerate(rows):
        for k in set(map(key, (r["text"] or "").split("\n"))):
            if len(k) >= lines.MIN_CHARS:
                seen[k].add(n)
                last[k] = max(last.get(k, -1), r["doc_id"])
    out = []
    for r in rows:
        told = (r["text"] or "").split("\n")
        kept = [x for x in told if len(seen[key(x)]) < lines.MIN_DOCS or last[key(x)] == r["doc_id"]]
        if len(kept) == len(told):
            out.append(r)
        elif "\n".join(kept):
            out.append(r | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))})
    return out


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def without_copies(rows):
    """By doc_id, each document stays unless one that stays is alike."""
    kept = []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        s = shingles(r["text"])
        if not any(alike(s, x) for _, x in kept):
            kept.append((r, s))
    return [r for r, _ in kept]


def mixed(rows, tmp_path):
    import pyarrow as pa

    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    copies = dict(c.sql(f"SELECT doc_id, copies FROM ({mixing.SQL})").fetchall())
    return [r for r in rows for _ in range(copies[r["doc_id"]])]


def tokens(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(public_tokenizers.path(bpe.RANKS)).read_bytes().splitlines())}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {r["doc_id"]: np.array(codec.encode_ordinary(r["text"] or ""), "<u4").tobytes() for r in rows}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return Counter((r["doc_id"], len(ids[r["doc_id"]]) // 4, digest(ids[r["doc_id"]]), digest((r["text"] or "").encode())) for r in rows)


def same(a, b):
    key = lambda r: sorted(map(repr, r.items()))
    return sorted(map(key, a)) == sorted(map(key, b))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stages_and_whole(spark, small, tmp_path, size):
    sf_dir = str(Path(small).parent / size)
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.trained(docs.select("doc_id", "text"), labels)
    plain = [lambda rows: good(rows, model), without_repeats, without_copies, lambda rows: mixed(rows, tmp_path)]
    df, rows = docs, rows_of(docs)
    for (name, stage), version in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        df = common.written(stage(spark, df, sf_dir), f"test-{name}")
        rows = version(rows)
        assert df.columns == docs.columns and same(rows_of(df), rows), name
        assert 0 < len(rows) <= 3 * docs.count()
    made = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).collect()
    assert all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in made)
    expected = tokens(rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made) == expected
    if size == "sf0.001":
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected


def test_recall_of_near_copies(spark, small):
    """Pairs of different texts at a resemblance of 0.8 or more in the largest table: no more than one in twenty stays whole, and nothing goes that isn't alike one that stays."""
    docs = common.table(spark, str(Path(small).parent / "sf0.1"), "documents")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    hashes = np.array([hash(x) for s in sets.values() for x in s])
    owners = np.repeat(np.array(list(sets)), [len(s) for s in sets.values()])
    order = np.argsort(hashes, kind="stable")
    ends = np.flatnonzero(np.r_[hashes[order][1:] != hashes[order][:-1], True]) + 1
    meet = set()
    for ids in {tuple(owners[order[a:b]].tolist()) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True) if 1 < b - a <= 60}:  # commoner shingles alone make no pair alike
        meet |= {(max(a, b), min(a, b)) for k, a in enumerate(ids) for b in ids[:k]}
    near = [(a, b) for a, b in meet if alike(sets[a], sets[b])]
    pairs = [(a, b) for a, b in near if texts[a] != texts[b]]
    kept = {r.doc_id for r in simhash.stage(spark, docs, "").select("doc_id").collect()}
    assert len(pairs) > 200
    assert sum(a in kept and b in kept for a, b in pairs) <= 0.05 * len(pairs)
    partners = defaultdict(set)
    for a, b in near:
        partners[a].add(b), partners[b].add(a)
    gone = texts.keys() - kept
    lonely = [i for i in gone if not partners[i] & kept and not any(alike(sets[i], sets[j]) for j in kept)]
    assert gone and not lonely
