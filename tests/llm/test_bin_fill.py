import itertools
import os
import random

import pytest

from tidemark.llm.bin_fill import VOCABULARY, container_use, count_tokens, encoding, fill_containers, fullest, pack

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files here")


def test_fullest_against_all_subsets():
    r = random.Random(1)
    for _ in range(200):
        lengths = sorted({r.randrange(1, 30): r.randrange(1, 3) for _ in range(5)}.items(), reverse=True)
        room = r.randrange(1, 70)
        taken = fullest(lengths, room)
        assert all(n <= dict(lengths)[k] for k, n in taken.items())
        best = max(s for c in itertools.product(*[range(n + 1) for _, n in lengths]) if (s := sum(k * n for (k, _), n in zip(lengths, c, strict=True))) <= room)
        assert sum(k * n for k, n in taken.items()) == best


def test_pack_places_everything_once_with_little_room_left():
    r = random.Random(2)
    items = [(i, min(8192, int(r.lognormvariate(5, 1)) + 1)) for i in range(3000)]
    sizes = {"s": 512, "m": 2048, "l": 8192}
    placed = pack(items, [(512, "s"), (2048, "m"), (8192, "l")])
    assert sorted(i for i, _, _ in placed) == list(range(3000))
    used, kind = {}, {}
    for i, k, b in placed:
        used[b] = used.get(b, 0) + dict(items)[i]
        kind[b] = k
    assert all(used[b] <= sizes[kind[b]] for b in used)
    assert sum(sizes[kind[b]] - used[b] for b in used) < 0.01 * sum(used.values())


@needs_vocabulary
def test_long_texts_count_like_whole_ones():
    text = " ".join(random.Random(3).choices(["goal", "Tor", "  ", "x1\n", "été", "🙂"], k=5000))
    for long in (text, "a\n\n  b" * 2000, "x" * 5000, "7 " * 3000, "don't  we'll " * 900, "日本語テキスト" * 700):
        assert count_tokens(long, VOCABULARY, 1000) == len(encoding(VOCABULARY).encode_ordinary(long))


@needs_vocabulary
def test_only_texts_beyond_the_largest_capacity_are_divided(spark):
    texts = [(1, "word " * 50, "c"), (2, "word " * 45, "c"), (2, "word " * 45, "c"), (3, None, "c"), (4, "", "c"), (5, "word " * 1000, "c"), (None, "x", "c"), (6, "\ud800 odd".encode("utf-8", "replace").decode(), "c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, tokens string")
    kinds = spark.createDataFrame([("a", 64), ("b", 256), (None, 9), ("z", 0)], "kind string, cap int")
    placed = fill_containers(docs, kinds, doc_id="doc_id", text="text", kind="kind", capacity="cap")
    rows = placed.collect()
    assert {r.doc for r in rows} == {1, 2, 5, 6}
    assert [r.doc for r in rows].count(2) == 2
    long = sorted((r.piece, r.first_token, r.tokens) for r in rows if r.doc == 5)
    assert sum(t for _, _, t in long) == count_tokens("word " * 1000, VOCABULARY) and all(t == 256 for _, _, t in long[:-1])
    assert all(r.tokens <= r.capacity for r in rows)
    use = container_use(placed).collect()
    assert all(u.unused >= 0 for u in use)
    assert fill_containers(docs.where("1 = 0"), kinds, doc_id="doc_id", text="text", kind="kind", capacity="cap").count() == 0
    assert fill_containers(docs, kinds.where("1 = 0"), doc_id="doc_id", text="text", kind="kind", capacity="cap").count() == 0
