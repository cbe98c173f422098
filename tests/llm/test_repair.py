"""Interval parsing against trying all edits, and against parsing with every split; odd conversations."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import pytest

from tallyward.llm import repair

GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        kind = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows):
    """Least (cost, audit, lines) over all edits of a few rows."""
    choices = []
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        own = [("D", 4, [])]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            own += [("K", more, [(role, text)])] + [("R", 3 + more, [(r, text)]) for r in ("user", "assistant")]
        choices.append(own)
    fills = [list(f) for n in range(3) for f in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for picked in itertools.product(*choices):
        # between rows only as much as brings a role that may follow
        states = [(0, "", [])]
        for letter, cost, lines in [*picked, ("", 0, [])]:
            new = {}
            for so_far, audit, kept in states:
                for fill in fills:
                    seq = kept + [(r, "") for r in fill] + lines
                    if not re.fullmatch(r"(s?(ua)*u?)?", "".join(r[:1] or "?" for r, _ in seq)):
                        continue
                    at = (so_far + cost + 3 * len(fill), audit + "I" * len(fill) + letter, seq)
                    key = (len(seq) and seq[-1][0][:1], len(seq) and seq[0][0][:1])
                    new.setdefault(key, []).append(at)
            states = [min(ways) for ways in new.values()]
        for cost, audit, seq in states:
            if GOOD.fullmatch("".join(r[:1] for r, _ in seq)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, seq)
    return best


def sums(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


SHAPES = ["", "u", "a", "s", "ua", "us", "uu", "aau", "suaua", "usa", "uxa", "ssua", "uaau", "auau", "uuuu", "aaaa", "uxxa", "suu"]


@pytest.fixture(scope="module")
def conversations():
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    out = []
    for shape in SHAPES:
        for ends in (".", "", "mix"):
            rows = [(i, names[c], f"line {i}{'' if ends == '' or (ends == 'mix' and i % 2) else '!'}") for i, c in enumerate(shape)]
            out.append(rows)
            if len(rows) > 1:
                out += [rows[:1] + rows, rows[:1] + [(1, "user", " \n")] + rows[1:], [(t * 3 if t else None, r, x) for t, r, x in rows]]
    return {i: rows for i, rows in enumerate(out) if rows}


def expected(rows):
    kinds = Counter(faults(rows))
    turns = {t for t, _, _ in rows if t is not None}
    roles = [r[:1] for _, r, _ in rows]
    cost, audit, lines = cheapest(rows)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, sums(lines))


def table(spark, conversations):
    rows = [(key, *row) for key, own in conversations.items() for row in own]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


@pytest.mark.parametrize("held", [1 << 25, 1])
def test_least_edits(spark, conversations, held, monkeypatch):
    # with one character held, every conversation takes the way of those that go on in another task
    monkeypatch.setattr(repair, "HELD", held)
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in repair.repairs(table(spark, conversations)).collect()}
    for key, rows in conversations.items():
        assert got[key] == expected(ordered(rows)), (key, rows)
    assert len(got) == len(conversations)


def test_repaired_turns_spell_the_pattern(spark, conversations):
    rows = repair.repaired_turns(table(spark, conversations)).orderBy("conv_id", "place").collect()
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repairs(table(spark, conversations)).collect()}
    for key, own in itertools.groupby(rows, key=lambda r: r.conv_id):
        kept = [(r.role, r.text) for r in own if r.edit != "D"]
        assert GOOD.fullmatch("".join(r[:1] for r, _ in kept)) and sums(kept) == digests[key]


def test_all_splits_give_one_cell():
    cells = [repair.terminal(i, f) for i, f in [("u", ""), ("u", "truncated"), ("", "blank"), ("s", ""), ("a", ""), ("a", "duplicate"), ("u", "")]]
    spans = {(i, i + 1): c for i, c in enumerate(cells)}
    for width in range(2, len(cells) + 1):
        for i in range(len(cells) - width + 1):
            made = {repair.joined(spans[i, k], spans[k, i + width]) for k in range(i + 1, i + width)}
            assert len(made) == 1
            spans[i, i + width] = made.pop()


def test_a_conversation_over_all_tasks(spark):
    # one conversation holds nearly all rows; one of its lines comes again and again
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}." if i % 5 else "again.") for i in range(3000)] + [(2, 0, "user", "hi."), (None, None, None, None)]
    rows += [(1, 7, "user", "copy.")] * 900
    got = {r.conv_id: r for r in repair.repairs(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)).collect()}
    one = sorted((r[1:] for r in rows if r[0] == 1), key=lambda r: r)
    seen, span = set(), repair.Span()
    for turn, role, text in one:
        span.row(turn, role, text, 1, (role, text) in seen)
        seen.add((role, text))
    found = span.found()
    assert {k: got[1][k] for k in found} == found and got[1].duplicate == 600 - 2 + 899
    assert got[2].audit == "KI" and got[None].blank == 1 and got[None].audit == "D"


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, place int, _key string")
    assert repair.repairs(empty).collect() == [] and repair.repaired_turns(empty).collect() == []
    long = spark.createDataFrame([(1, 0, "user", "x" * 300_000 + "."), (1, 1, "", "."), (1, None, "assistant", "y?")], "conv_id bigint, turn bigint, role string, text string")
    r = repair.repairs(long.withColumn("audit", long.role)).first()
    assert (r.cost, r.illegal) == (6, 1)


def test_damage(spark, small):
    before = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    after = Counter(tuple(r) for r in repair.damaged(spark.read.parquet(f"{small}/conversations.parquet")).collect())
    want = Counter()
    for (conv, turn), r in before.items():
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        if kind:
            want[conv, turn, "user" if kind == 4 else r.role, text] += 2 if kind == 3 else 1
    assert after == want
