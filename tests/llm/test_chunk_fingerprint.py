"""Content-defined chunks: cutting against a plain loop, containment, edited texts."""

import hashlib
import random

import pytest
import xxhash

from kerbline.llm import chunk_fingerprint as cf


def slow_chunks(text):
    """One byte at a time; the hash holds the last 32 bytes, blank before the text."""
    line = b"\0" * 32 + text
    out, start, n = {}, 0, len(text)

    def gear(i):
        h = 0
        for b in line[i + 1:i + 33]:
            h = (h * 2 + int(cf.GEAR[b])) % 2**32
        return h

    while start < n:
        end = min(start + 256, n)
        if n - start > 16:
            for i in range(start + 16, end):
                if gear(i) < (2**25 if i < start + 64 else 2**27):
                    end = i + 1
                    break
        else:
            end = n
        piece = text[start:end]
        out[xxhash.xxh64_intdigest(piece) >> 16] = len(piece)
        start = end
    return out


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(n))


def test_chunks_match_a_plain_loop():
    rng = random.Random(2)
    texts = [prose(rng, n).encode() for n in (0, 1, 3, 20, 200)] + [b"", b"a" * 700, b"\0" * 100, bytes(range(128)) * 4]
    got = cf.chunks(texts)
    assert got == [slow_chunks(t) for t in texts]
    assert all(cf._from_text(cf.as_text(x)) == x for x in got)


def test_insertions_move_few_chunks():
    rng = random.Random(4)
    text = prose(rng, 2000)
    a, b = cf.chunks([text.encode(), ("new start " + text[:5000] + " put in between " + text[5000:]).encode()])
    assert cf.contained(a, b) > 0.95
    c, = cf.chunks([prose(rng, 2000).encode()])
    assert cf.contained(a, c) < 0.02
    part, = cf.chunks([text[3000:9000].encode()])
    assert cf.contained(part, a) > 0.95 > 0.6 > cf.contained(a, part)
    assert (cf.contained({}, {}), cf.contained({}, a), cf.contained(a, {})) == (1.0, 0.0, 0.0)


def slow_rows(rows):
    """Ids descending, NULL last, rows of one id by the hash of their text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + 2**63) % 2**64))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        a, b, c = cf.chunks([text.encode(), edited.encode(), after.encode()])
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), cf.as_text(a), cf.as_text(b),
                    cf.contained(a, b), cf.contained(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_every_document_meets_its_next(spark, buckets):
    rng = random.Random(buckets)
    rows = [(rng.randrange(-50, 900) * 7, prose(rng, rng.randrange(60))) for _ in range(90)]
    rows += [(3, None), (3, ""), (3, "aé"), (5, "twice"), (5, "twice"), (None, "no id"), (None, None), (max(rows)[0], "the same top id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_chars string").repartition(5)
    got = sorted((tuple(r) for r in cf.with_next(docs, buckets).collect()), key=str)
    assert got == slow_rows(rows)


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    assert cf.with_next(docs).first().near_next == 1.0
    assert cf.with_next(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert cf.with_next(nulls).count() == 2
    marked = cf.fingerprints(docs.union(nulls)).collect()
    assert [r.fingerprint == "" for r in marked] == [False, False, True]
    near = docs.select(cf.containment(cf.F.lit("00000000000a:3 00000000000b:1"), cf.F.lit("00000000000a:3")).alias("c")).first().c
    assert near == 0.75
