"""Each registered query against its SQL, or a plain version of the same thing."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

import __spark_entry__ as entry
from tallyward.llm import fingerprints, packing
from tallyward.llm.queries import ORACLES

from .conftest import WORD


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, small, result):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{small}/{table}.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = result(name)
    assert set(columns) == set(got[0].asDict())

    def plain(values):
        return tuple(round(v, 6) if isinstance(v, float) else v for v in values)

    assert sorted((plain(r[c] for c in columns) for r in got), key=repr) == sorted(map(plain, cursor.fetchall()), key=repr)


def test_line_dedup_finds_near_lines(result):
    assert sum(r.n_exact for r in result("op1_")) > 0


def test_secrets(result, text_rows):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in result("op3_")}
    for doc, text in text_rows:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        kinds = ("assign", "access", "hex")
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[doc]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_language_model(result, text_rows):
    def tokens(text):
        return WORD.findall(text.encode().lower()) + [None]

    counts = Counter()
    for doc, text in text_rows:
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    known = model = 0.0
    for r in result("op4_"):
        t = tokens(dict(text_rows)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[x] > 0 for x in t), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
        if r.held_out:
            known, model = known + r.n_tokens, model + r.score
    assert -6.5 < model / known < -2.5


def units_of(text):
    """(start, end, words) of sentences and of their pieces, cut after the pair of words with the least hash for five pairs on both sides."""
    out, at = [], 0
    while at < len(text):
        mark = re.compile(r"[.!?][)\"'»”]*[ \t\r]+|\n").search(text, at)
        end = mark.end() if mark else len(text)
        words = [(m.start(), m[0].lower()) for m in re.compile(r"\S+").finditer(text, at, end)]
        digest = [xxhash.xxh3_64_intdigest(w) for _, w in words]
        pairs = [(x * 0x9E3779B97F4A7C15 + y) % 2**64 for x, y in itertools.pairwise(digest)]
        starts = [i + 1 for i in range(5, len(pairs) - 5) if pairs[i - 5 : i + 6].index(min(pairs[i - 5 : i + 6])) == 5]
        edges = [at, *[words[i][0] for i in starts], end]
        own = [0, *starts, len(words)]
        out += [(edges[k], edges[k + 1], tuple(w for _, w in words[own[k] : own[k + 1]])) for k in range(len(edges) - 1)]
        at = end
    return out


def test_passages(result, text_rows):
    seen, got = set(), {r.doc_id: r for r in result("op6_")}
    for doc, text in text_rows:
        runs = [[]]
        for a, b, words in units_of(text):
            if words and words not in seen:
                runs.append([])
            elif words or runs[-1]:
                runs[-1].append((a, b, len(words)))
            seen.add(words)
        spans = []
        for run in runs:
            while run and not run[-1][2]:
                run.pop()
            if sum(n for _, _, n in run) >= 13:
                spans.append((run[0][0], run[-1][1]))
        kept = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in spans))
        assert got[doc].spans == ",".join(f"{a}:{b}" for a, b in spans)
        assert got[doc].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r.n_removed for r in got.values()) > 0


def test_packing(result, text_rows):
    rows = result("op7_")
    sizes = {doc: len(WORD.findall(text.encode())) + 1 for doc, text in text_rows}
    per_doc, batches = Counter(), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_tokens <= packing.MAX_TOKENS
        batches[r.bucket_tokens, r.batch].append(r.slot)
    assert per_doc == sizes
    last = {b: max(n for k, n in batches if k == b) for b, _ in batches}
    for (bucket, number), slots in batches.items():
        fit = max(1, packing.BUDGET // bucket)
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) == fit if number < last[bucket] else len(slots) <= fit


def test_exact_substrings(result, text_rows):
    seen, got = set(), {r.doc_id: r for r in result("op8_")}
    for doc, text in text_rows:
        data = text.encode()
        cover = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                cover[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(x for x, c in zip(data, cover, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), sum(cover), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_fingerprints(result, text_rows, shingles):
    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got, prints = {r.doc_id: r for r in result("op9_")}, {}
    for i, (doc, text) in enumerate(text_rows):
        after, n = text_rows[(i + 1) % len(text_rows)][1], len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness(shingles(text), shingles(edited))) < 0.2
        assert abs(r.near_next - likeness(shingles(text), shingles(after))) < 0.2
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        a, b = fingerprints.decode(r.fingerprint), fingerprints.decode(r.edited_fingerprint)
        assert abs(fingerprints.distinct_count(a) / max(1, len(shingles(text))) - 1) < 0.4 or not text.strip()
        part = len(shingles(text) & shingles(edited)) / max(1, len(shingles(text)))
        assert abs(fingerprints.containment(a, b) - part) < 0.3 or not text.strip()


def test_fingerprints_of_parts_merge():
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 2**63, 900).astype(np.uint64)) for _ in range(2))
    merged = fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b))
    assert (merged == fingerprints.sketch(np.union1d(a, b))).all()


def test_jaccard_join(result, text_rows, shingles):
    sets = {doc: shingles(text) for doc, text in text_rows}
    least = {doc: doc for doc in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    for r in result("op10_"):
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
