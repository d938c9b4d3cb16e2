"""The filter audit, the manifest and personal data against brute force, on edge tables, and held-out draws."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from lorekeep.llm import audit, merkle, pii
from test_training_operators import edge  # noqa: F401

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows_of(folder, *columns):
    t = pq.read_table(f"{folder}/documents.parquet")
    return list(zip(*(t[c].to_pylist() for c in columns), strict=True))


# Filter audit


def test_shapley_is_the_mean_over_orders():
    draw = random.Random(1)
    for n in (1, 2, 3, 5):
        values = [draw.randint(-50, 50) for _ in range(1 << n)]
        mean = [Fraction(0)] * n
        orders = list(itertools.permutations(range(n)))
        for order in orders:
            before = 0
            for i in order:
                mean[i] += Fraction(values[before | 1 << i] - values[before], len(orders))
                before |= 1 << i
        assert audit.shapley(values, n) == mean


def plain_audit(rows, labels):
    """Every order applied filter by filter to every document."""
    smallest, parts = {}, {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    for doc_id, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = "".join(
            f
            for f, test in zip(
                "ABCDE",
                (
                    len(words) < 100,
                    100 * len(set(words)) < 80 * len(words),
                    100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                    bool(re.search("[#$%&*|]", text)),
                    doc_id is not None and doc_id > smallest[text],
                ),
                strict=True,
            )
            if test
        )
        own = labels.get(doc_id, [])
        parts.setdefault(lang or "", []).append((fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = {}
    for part, docs in parts.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                fails = [d for d in docs if f in d[0]]
                good, toxic = sum(d[1] for d in gone), sum(d[2] for d in gone)
                out[part, order, step] = (len(left), len(gone), len(fails) - len(gone), sum(d[0] == f for d in docs), good, toxic)
        for key in out:
            if key[0] == part:
                out[key] += (total[key[1][key[2] - 1]],)
    return out


@pytest.mark.parametrize("where", ["edge", "unlabelled", "small"])
def test_audit_by_definition(spark, edge, small, where):
    folder = edge.get(where, small)
    t = pq.read_table(f"{folder}/labels.parquet")
    labels = {}
    for doc_id, quality, toxic in zip(*(t[c].to_pylist() for c in ("doc_id", "quality", "toxic")), strict=True):
        if doc_id is not None:
            labels.setdefault(doc_id, []).append((quality, toxic))
    made = audit.op11_audit(spark, folder).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in made} == plain_audit(rows_of(folder, "doc_id", "text", "lang"), labels)


# Manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(made, place):
    for level in made[:-1]:
        first = place // 3 * 3
        yield level[first:place], level[place + 1 : first + 3]
        place //= 3


def plain_proofs(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in names}
    trees = {s: levels([plain_leaf(r) for r in own[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for nth, s in enumerate(names):
        for place, row in enumerate(own[s]):
            path = [*siblings(trees[s], place), *siblings(top, nth)]
            changed = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = plain_leaf((*row[:4], row[4].replace("\n", ""))) if changed else plain_leaf(row)
            for low, high in path:
                node = digest("".join([*low, node, *high]))
            proof = digest("".join(x for low, high in path for x in [*low, *high]))
            yield row[0], plain_leaf(row), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]


@pytest.mark.parametrize(("where", "depth"), [("edge", 1), ("edge", 6), ("small", 1), ("small", 2), ("small", 6)])
def test_proofs_by_definition(spark, edge, small, where, depth):
    """Over one segment and over several, with null and repeated ids, null sources, repeated rows and a source of one leaf."""
    folder = edge.get(where, small)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*merkle.FIELDS)
    made = merkle.proofs(merkle.manifest(docs, depth))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(plain_proofs(rows_of(folder, *merkle.FIELDS)), key=key)


def test_records_name_their_content(spark, small):
    """Every record's digest is that of its children; changes are seen, rows without line ends are not changed."""
    made = merkle.manifest(spark.read.parquet(f"{small}/documents.parquet").select(*merkle.FIELDS), 2)
    for segment in [*made.trees.segments, *made.top.segments]:
        for r in segment.where("children is not null").collect():
            assert 1 <= len(r.children) <= 3 and r.digest == digest("".join(r.children))
    seen = {r.verified for r in merkle.proofs(made).collect()}
    assert seen == {True, False}


def test_one_source_and_one_leaf(spark):
    one = spark.createDataFrame([(5, None, "en", None, "a\nb")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = merkle.proofs(merkle.manifest(one)).collect()
    assert row.leaf == row.subroot == row.root == plain_leaf((5, None, "en", None, "a\nb")) and row.proof_sha256 == digest("")


# Personal data

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            if {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn,
                "phone": 9 <= len(digits) <= 15,
            }[kind]:
                out.append((*m.span(), kind))
    return pii.joined(out)


def test_base_patterns_on_drawn_texts():
    draw = random.Random(3)
    pieces = ["a", "b.", "@", "x@y.z", "é", " ", "-", "+", "1", "0", "25", "255", ".", "4", "(", ")", "1.2.3.4", "256.1.1.1.7", "+4 9", "4242424242424242", "%", "\n", "@@", ".."]
    for _ in range(6000):
        text = "".join(draw.choices(pieces, k=draw.randint(1, 24)))
        assert pii.joined(pii.in_code_points(text.encode(), pii.base_spans(text.encode()))) == plain_base(text), text


def test_pii_query(spark, small):
    made = {r.doc_id: r for r in pii.op13_pii(spark, small).collect()}
    model = pii.field()
    for doc_id, text in rows_of(small, "doc_id", "text"):
        base, r = plain_base(text), made[doc_id]
        assert r.base_sha256 == digest(base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(k + ":") for k in pii.BASE_KINDS)
        own = pii.labelled([(text, pii.in_code_points(text.encode(), pii.base_spans(text.encode())))], model)[0]
        assert set(r.spans.split(",")) == set(base.split(",")) | set(pii.joined(own).split(",")) - ({""} if r.spans else set())


def exact(model, scores, edges):
    """Marginals over all labelings."""
    n, k = scores.shape
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        s = sum(scores[i, x] for i, x in enumerate(labels)) + sum(model.pair[t, labels[a], labels[b]] for a, b, t in edges)
        for i, x in enumerate(labels):
            total[i, x] += np.exp(s)
    return total / total.sum(1, keepdims=True)


def test_messages_on_trees_are_exact():
    draw = np.random.default_rng(2)
    model = pii.Field({}, np.zeros((1, 3)), draw.normal(size=(4, 3, 3)))
    for edges in ([(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 3)], [(0, 1, 0)], []):
        scores = draw.normal(size=(5, 3))
        got = model.beliefs(scores, np.array(edges, np.int64).reshape(-1, 3), rounds=60)
        assert np.allclose(got, exact(model, scores, edges), atol=1e-6)


def test_messages_on_a_loop_are_near():
    draw = np.random.default_rng(4)
    model = pii.Field({}, np.zeros((1, 3)), draw.normal(size=(4, 3, 3)) * 0.5)
    edges = [(0, 1, 0), (1, 2, 0), (2, 3, 1), (0, 3, 2)]
    scores = draw.normal(size=(4, 3))
    assert np.abs(model.beliefs(scores, np.array(edges)) - exact(model, scores, edges)).max() < 0.08


def found_in(text):
    base = pii.in_code_points(text.encode(), pii.base_spans(text.encode()))
    return [(kind, text[a:b]) for a, b, kind in pii.labelled([(text, base)], pii.field())[0]]


def test_a_distant_mention_is_told_by_the_first():
    filler = "Onthe retion of lichen stanre. " * 40
    text = f"Onre the wh Mr. Thornbury, whst on. {filler}Reth an Thornbury onre. {filler}Ingle Thornbury's erst."
    assert found_in(text) == [("name", "Thornbury"), ("name", "Thornbury"), ("name", "Thornbury's")]
    assert not found_in(f"Onre the wh. {filler}Reth an Thornbury onre 12 of. {filler}Ingle Thornbury's erst.")
    text = f"Onre +1 (499) 555-6503 st. {filler}Reth 555-6503 onre."
    assert ("local_phone", "555-6503") in found_in(text)
    assert not found_in(f"{filler}Reth 7012 onre 555 of st.")


def test_held_out_draws():
    """Per label: at least 0.9 of the tokens of fresh documents are found, at most 0.1 of those found stand outside personal data."""
    source, model = pii.Draw(1234), pii.field()
    met, lost, wrong = Counter(), Counter(), Counter()
    for _ in range(400):
        text, spans = source.document()
        base = pii.in_code_points(text.encode(), pii.base_spans(text.encode()))
        free = [m.span() for m in pii.TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in base)]
        label_of = lambda s, spans: next((k for a, b, k in spans if a < s[1] and s[0] < b), "none")
        got = pii.labelled([(text, base)], model)[0]
        for s in free:
            want, has = label_of(s, spans), label_of(s, got)
            if want not in ("none", "base"):
                met[want] += 1
                lost[want] += has == "none"
            wrong[has] += has != "none" and want == "none"
    for label in pii.LABELS[1:]:
        assert met[label] > 40 and lost[label] <= 0.1 * met[label], (label, met, lost)
        assert wrong[label] <= 0.1 * met[label], (label, wrong)


def test_long_texts_take_linear_time():
    for text in ("x" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 20_000, "+1 " * 13_000, "x." * 200_000 + "@", "Mr " * 13_000):
        base = pii.in_code_points(text.encode(), pii.base_spans(text.encode()))
        pii.labelled([(text, base)], pii.field())
