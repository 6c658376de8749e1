"""Packing against best-fit decreasing over single pieces, and ids against whole-text encoding."""

import random
import zlib
from bisect import bisect_left, insort

import pytest
from corpus_words import words


def best_fit(sizes, cap):
    rooms, n = [], 0  # in order
    for s in sorted(sizes, reverse=True):
        k = bisect_left(rooms, s)
        n += k == len(rooms)
        insort(rooms, (rooms.pop(k) if k < len(rooms) else cap) - s)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_over_pieces(seed):
    from tessella.llm.packing import plan_slots

    r = random.Random(seed)
    cap = r.choice([7, 50, 64])
    sizes = [r.randint(1, cap) if r.random() < 0.7 else cap for _ in range(r.choice([1, 40, 900]))]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    taken = {}
    for size, lo, hi, first, each, offset in plan_slots(histogram, cap):
        for x in range(hi - lo):
            taken.setdefault(first + x // each, []).append((offset + x % each * size, size))
        histogram[size] -= hi - lo
    assert not any(histogram.values())
    for slots in taken.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(s for _, s in slots[:k]) for k in range(len(slots))]
        assert sum(s for _, s in slots) <= cap
    assert len(taken) == best_fit(sizes, cap)


def test_pack(spark, odd, odd_rows, nothing):
    from tessella.llm.packing import pack, word_tokenizer
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    extra = [(20, "Ȧ́ b c\x0bd\x85e <|endoftext|>x ΑΣ ΑΣ. don't 12 345"), (21, "".join(words(5, 30_000).split(" "))), (22, words(6, 90_000))]
    rows = odd.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    for cap in (2048, 64):
        got = pack(rows, max_tokens=cap).collect()
        by_sequence = {}
        for r in got:
            assert len(r.ids) == 4 * r.length and 1 <= r.length <= cap and r.start == cap * r.piece
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for slots in by_sequence.values():
            slots.sort()
            assert [o for o, _ in slots] == [sum(n for _, n in slots[:k]) for k in range(len(slots))] and sum(n for _, n in slots) <= cap
        assert len(by_sequence) == best_fit([r.length for r in got], cap)
        want = []
        for i, x in [r[:2] for r in odd_rows] + extra:
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
            want += [(i, k // cap, zlib.crc32(b"".join(n.to_bytes(4, "little") for n in ids[k : k + cap]))) for k in range(0, len(ids), cap)]
        assert sorted(((r.doc_id, r.piece, zlib.crc32(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    assert pack(nothing).count() == 0


def test_one_length_holds_most_rows(spark):
    from tessella.llm.packing import place

    pieces = spark.range(20_000).selectExpr("id doc_id", "0 piece", "case when id % 10 < 7 then 900L else id % 300 + 1 end length")
    got = place(pieces).groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).collect()
    sizes = [900 if i % 10 < 7 else i % 300 + 1 for i in range(20_000)]
    assert max(r["sum(length)"] for r in got) <= 2048 and sum(r["sum(length)"] for r in got) == sum(sizes)
    assert len(got) == best_fit(sizes, 2048)
