"""Operator 4: ids against the tokenizer, places against the rules, numbers of sequences against a bound."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm.packing import WordIds, pack, plan_slots  # noqa: E402
from tessera.llm.queries import op4_best_fit_packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
WORDS, TOKENIZER = WordIds(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("aé'sS_3½ \t\n<|>µİŉ²¹ªendoftextßÿĀ¤ ­\x1c\x85-.ll’"), st.text(st.characters(max_codepoint=0x250))))
def test_ids_equal_the_tokenizers(text):
    assert np.frombuffer(WORDS.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def one_by_one(counts, limit):
    """Sequences that plain best fit, longest first, opens."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(rooms, length)
            room = rooms.pop(at) if at < len(rooms) else limit
            bisect.insort(rooms, room - length)
    return len(rooms)


def test_plan_fills_slots_once():
    rng = random.Random(5)
    for limit in (7, 64, 4096):
        counts = {n: rng.choice([1, 2, 50, 300]) for n in rng.sample(range(1, limit + 1), min(limit, 60))}
        used = defaultdict(list)
        for length, runs in plan_slots(counts, limit).items():
            bounds = [*runs[:, 0].tolist(), counts[length]]
            assert bounds == sorted(bounds) and bounds[0] == 0
            for (first, each, base, at), end in zip(runs.tolist(), bounds[1:], strict=True):
                for rank in range(first, end):
                    used[base + (rank - first) // each].append((at + (rank - first) % each * length, length))
        for slots in used.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= limit
        assert len(used) == one_by_one(counts, limit)
        assert sorted(used) == list(range(len(used)))


def check(rows, texts, limit=4096):
    ids = {d: [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.start == r.piece * limit
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.start, r.length))
    assert {d: sum(n for _, n in c) for d, c in covered.items()} == {d: len(x) for d, x in ids.items()}
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences), -(-sum(map(len, ids.values())) // limit)


def test_whole_table(spark):
    rows = op4_best_fit_packing(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, least = check(rows, texts)
    assert n <= least * 1.05 + 1


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "a " * 9000, 4: "b" * 5000, 5: "<|endoftext|> ’ 漢字", None: "x y"}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, length int")
    rows = pack(docs.repartition(3), PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 9001
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert pack(docs.where("false"), PATH).count() == 0


def test_repeated_rows_and_other_columns(spark):
    """Repeated rows are packed each for itself, without gaps or overlaps; other columns are not looked at, whatever their names."""
    rows = [(1, "a b c " * 300, 7, "x")] * 9 + [(2, None, 7, "x")] * 5 + [(None, "a " * 9000, 7, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, offset string").repartition(5)
    out = pack(df, PATH, limit=512).collect()
    single = {i: [(r.piece, r.start, r.length, bytes(r.ids)) for r in sorted(pack(df.where(df.doc_id.eqNullSafe(i)).limit(1), PATH, limit=512).collect(), key=lambda r: r.piece)] for i in (1, 2, None)}
    for i, n in ((1, 9), (2, 5), (None, 2)):
        assert sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in out if r.doc_id == i) == sorted(single[i] * n)
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512


def test_frequent_words_stay_known(monkeypatch):
    """Words that go on being used are tokenized no more than a few times, however many rare ones come between, and nothing is kept without bound."""
    from tessera.llm import packing

    monkeypatch.setattr(packing, "CHUNKS", 50)
    monkeypatch.setattr(packing, "WORDS", 50)
    words = WordIds(PATH)
    made, rng = [], random.Random(3)
    make = words.words.make
    words.words.make = lambda w: made.append(w) or make(w)
    for i in range(300):
        rare = " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(10))
        text = f"The cat, {rare} the\x1cend. {'x' * 90}" if i % 7 == 0 else f"The cat, {rare} {'x' * 90} THE {i}"
        assert np.frombuffer(words.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert made.count("the") == made.count("cat") == 1
    assert all(len(d) <= 51 and all(len(k) <= packing.LONGEST for k in d) for kept in (words.words, words.chunks) for d in (kept, kept.before))
