"""Evaluation texts leaking into training text.

Texts are compared as streams of their letters and digits, so that spacing, punctuation, markup, letter case and
character forms don't matter. The items are an inverted index over k-grams of their streams, with BM25 impacts and
maxima of blocks of items; every passage of every document is a query, answered by block-max WAND with all items above
a score: blocks whose maxima can't reach it are skipped without reading a posting. What is retrieved is verified by
chaining the matching runs of both streams and counting the item's words they hold, and its answer is looked up in the
document. The index is flat arrays, about 60 bytes a character of the items.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut, spread

TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
OTHER = re.compile(r"[\W_]+")
#: Letters that look like Latin ones, and letters that NFKD doesn't take apart: fixed values.
LOOKALIKE = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ԁ": "d", "ӏ": "l", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "ι": "i", "κ": "k", "ε": "e", "υ": "u", "χ": "x", "η": "n", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ŋ": "n", "ħ": "h",
})
GRAM = 7
BLOCK = 16
MISS = 2.0
EDGE = 2
SHARE, EDGE_SHARE = 0.5, 0.85
#: An untrimmed chain's least share of the squared word weights and of the words.
CHAIN_SHARE, CHAIN_HELD = 0.6, 0.75
#: Words on either side that may foretell a word, and the least share held of the words that none foretells.
NEAR, OWN_SHARE = 4, 0.55
#: The score that any unedited passage of the least length has at least: three times the threshold.
LEVEL = 300.0
#: Edited words that an edge may go beyond, and letters that may stand in their place.
SKIP, SLACK = 2, 12


def plain(text: str) -> str:
    """Small letters without marks, markup, entities, broken UTF-8 read as Latin-1, or look-alike letters."""
    if "Ã" in text or "Å" in text or "â€" in text:
        text = re.sub("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-™]+", _mend, text)
    text = TAG.sub(" ", html.unescape(text) if "&" in text else text)
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", text).casefold().translate(FOLD)


class _Fold(dict):
    """Look-alikes by code point, nothing for combining marks, all else as it is; found once for each character."""

    def __missing__(self, code: int) -> int | str | None:
        self[code] = kept = LOOKALIKE.get(code, None if unicodedata.combining(chr(code)) else code)
        return kept


FOLD = _Fold()


def _mend(found: re.Match[str]) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return found[0].encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return found[0]


def stream(text: str | None) -> np.ndarray:
    """The code points of letters and digits of the plain text."""
    return np.frombuffer(OTHER.sub("", plain(text or "")).encode("utf-32-le", "replace"), np.uint32)


def spelled(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all k-grams of a stream."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def word_hashes(words: list[str]) -> np.ndarray:
    known = {w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little") for w in set(words)}
    return np.array([known[w] for w in words], np.uint64)


def word_pairs(hashes: np.ndarray, apart: int) -> np.ndarray:
    """64-bit hashes of each word with the one ``apart`` words later."""
    h = (hashes[:-apart] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[apart:] + np.uint64(apart))
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Item:
    """A text and its ``owners``: the ids that have it, with their answers. ``grams`` are sorted, ``places`` says where
    they are; ``words`` are the places at which words begin and the end, ``weight`` how rare they are, ``own`` how little
    other items foretell them by the words around: 0 for words of sentences that many items have, 1 for what only this
    item puts in there."""

    owners: list[tuple[int, str]]
    codes: np.ndarray
    grams: np.ndarray
    places: np.ndarray
    words: np.ndarray
    weight: np.ndarray
    own: np.ndarray

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` and in the item of all grams that both have."""
        lo, hi = np.searchsorted(self.grams, hashes, "left"), np.searchsorted(self.grams, hashes, "right")
        at = np.flatnonzero(hi > lo)
        return np.repeat(at, hi[at] - lo[at]), self.places[spans(lo[at], hi[at])]


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers from each start to below its end, one after the other."""
    n = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def _least_score(item: Item, scores: np.ndarray, least_words: int) -> float:
    """The least score of the distinct grams in any passage of so many words, or in the whole of a shorter item.
    ``scores`` are those of the sorted grams."""
    usual = len(item.codes) * least_words // max(1, len(item.weight))
    # places rise within equal grams; one that was there within the passage's usual length is no new one
    again = np.r_[False, (np.diff(item.places) <= usual) & (item.grams[1:] == item.grams[:-1])]
    new = np.zeros(len(scores))
    new[item.places] = np.where(again, 0.0, scores)
    sums = np.r_[0.0, np.cumsum(new)]
    n = min(least_words, len(item.weight))
    starts = np.minimum(item.words[: len(item.weight) - n + 1], len(scores))
    full = sums[np.maximum(starts, np.minimum(item.words[n:] - GRAM + 1, len(scores)))] - sums[starts]
    return float(min(full[full > 0], default=sums[-1]))


@dataclass
class Index:
    """``terms``: sorted gram hashes. The postings of term t are ``first[t]`` to ``first[t + 1]`` of ``docs``, item
    numbers in order, and ``impact``, their BM25 impacts. They fall into blocks of BLOCK neighbouring items, the same
    for all terms: those of t are ``block_first[t]`` to ``block_first[t + 1]`` of ``block``, the number of the block,
    ``block_max``, its greatest impact, and ``block_at``, where its postings begin. ``top``: the greatest impact of t."""

    items: list[Item]
    terms: np.ndarray
    first: np.ndarray
    docs: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    block_at: np.ndarray
    top: np.ndarray

    @classmethod
    def build(
        cls, rows: list[tuple[int, str | None, str | None]], k1: float = 1.2, b: float = 0.75, *, least_words: int = 25, total: int | None = None, mean: float | None = None, common: dict[str | int, int] | None = None
    ) -> Index:
        """Equal texts are one item. Of a part of the items, ``total`` is the number of all texts, ``mean`` their mean
        number of grams and ``common`` has the texts of those words, grams and pairs of words that more than one has. Impacts of items
        whose passages of ``least_words`` words would score less than LEVEL are raised to it, so that a threshold means
        the same in any index."""
        owners: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for item_id, text, answer in rows:
            owners[text or ""].append((item_id, answer or ""))
        items, told = [], {text: re.findall(r"[^\W_]+", plain(text)) for text in owners}
        spread = Counter(w for words in told.values() for w in set(words))
        total, often = total or len(owners), common or {}
        keys = np.array(sorted(k for k in often if not isinstance(k, str)), np.uint64)
        of_keys = np.array([often[int(k)] for k in keys], float)

        def texts_of(hashes: np.ndarray, here: np.ndarray) -> np.ndarray:
            """The texts that have each hash, ``here`` of them in this part."""
            if not len(keys):
                return here.astype(float)
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            return np.where(keys[at] == hashes, of_keys[at], here)

        hashed = {text: word_hashes(words) for text, words in told.items()}
        pairs = {}
        for apart in range(1, NEAR + 1):
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(word_pairs(h, apart)) for h in hashed.values())]), return_counts=True)
            pairs[apart] = found, texts_of(found, n)
        for text, words in told.items():
            codes = stream(text)
            if len(codes) >= GRAM:
                weight = np.array([1 + np.log(total / often.get(w, spread[w])) for w in words])
                hashes = grams(codes)
                order = np.argsort(hashes, kind="stable")
                others, foretold = np.array([often.get(w, spread[w]) for w in words]) - 1.0, np.zeros(len(words))
                for apart, (found, n) in pairs.items():
                    if len(words) > apart:
                        both = n[np.searchsorted(found, word_pairs(hashed[text], apart))] - 1
                        foretold[apart:] = np.maximum(foretold[apart:], both / np.maximum(others[:-apart], 1))
                        foretold[:-apart] = np.maximum(foretold[:-apart], both / np.maximum(others[apart:], 1))
                items.append(Item(owners[text], codes, hashes[order], order.astype(np.int32), np.cumsum([0] + [len(w) for w in words]), weight, 1 - np.minimum(foretold, 1)))
        none = np.empty(0, np.int64)
        if not items:
            return cls([], none.astype(np.uint64), np.zeros(1, np.int64), none, none.astype(float), np.zeros(1, np.int64), none, none.astype(float), none, none.astype(float))
        sizes = np.array([len(x.grams) for x in items])
        every, owner = np.concatenate([x.grams for x in items]), np.repeat(np.arange(len(items)), sizes)
        order = np.lexsort((owner, every))
        g, n = every[order], owner[order]
        fresh = np.r_[True, (g[1:] != g[:-1]) | (n[1:] != n[:-1])]
        pair = np.flatnonzero(fresh)
        tf, docs = np.diff(np.r_[pair, len(g)]), n[pair]
        terms, first = np.unique(g[pair], return_index=True)
        first = np.r_[first, len(pair)]
        texts = texts_of(terms, np.diff(first))
        idf = np.log(1 + (np.maximum(total, texts) - texts + 0.5) / (texts + 0.5))
        long = sizes[docs] / (mean or sizes.mean())
        impact = np.repeat(idf, np.diff(first)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * long))
        score = np.empty(len(g))
        score[order] = impact[np.cumsum(fresh) - 1]
        ends = np.cumsum(sizes)
        raised = np.array([max(1.0, LEVEL / max(1e-9, _least_score(x, score[e - m : e], least_words))) for x, e, m in zip(items, ends, sizes, strict=True)])
        impact = impact * raised[docs]
        numbers, term = docs // BLOCK, np.repeat(np.arange(len(terms)), np.diff(first))
        begins = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (term[1:] != term[:-1])])
        block_first = np.searchsorted(term[begins], np.arange(len(terms) + 1))
        return cls(items, terms, first, docs.astype(np.int32), impact, block_first, numbers[begins].astype(np.int32), np.maximum.reduceat(impact, begins), begins, np.maximum.reduceat(impact, first[:-1]))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of gram hashes, -1 for those of no item."""
        if not len(self.terms) or not len(hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def above(self, query: np.ndarray, threshold: float) -> list[int]:
        """Item numbers whose BM25 score for the distinct query terms reaches the threshold, by block-max WAND. Terms
        are at one block of items at a time; the maxima of those that have postings in it bound the score of any item
        there, so blocks below the threshold are passed over, and postings are only read and summed in the others."""
        held = spans(self.block_first[query], self.block_first[query + 1])
        bound = np.bincount(self.block[held], self.block_max[held], minlength=1)
        if not (bound >= threshold).any():
            return []
        held = held[bound[self.block[held]] >= threshold]
        ends = np.r_[self.block_at[1:], len(self.docs)]
        at = spans(self.block_at[held], ends[held]) if len(held) else held
        score = np.bincount(self.docs[at], self.impact[at])
        return np.flatnonzero(score >= threshold).tolist()


@dataclass(frozen=True)
class Verdict:
    """``words`` of the item; of its best passage the ``first`` word, its ``length``, the words ``held`` and their ``share`` of the squared word weights, which is low where only what many items have in common was held. ``own``: the
    share held of what is the item's own, which is low where the document has the same sentences of a kind with other
    names and numbers in them. ``whole``: the passage isn't trimmed, edited words near its edges count."""

    words: int
    first: int
    length: int
    held: int
    share: float
    own: float
    whole: bool = False

    def passes(self, least_words: int) -> bool:
        """Edges may be edited: where most of the rarer words are held, or those of a whole chain, two words less do."""
        if self.own < OWN_SHARE:
            return False
        if self.whole:
            return self.share >= CHAIN_SHARE and self.held >= CHAIN_HELD * self.length and self.length + EDGE >= min(least_words, self.words)
        return self.share >= SHARE and self.length + (EDGE if self.share >= EDGE_SHARE else 0) >= min(least_words, self.words)


def beyond(words: list[str], text: str) -> list[int]:
    """Places of those first ``words`` that ``text`` begins with, in order, up to SKIP edited ones in a row. Short words
    only count along with the next one, as they are found anywhere."""
    found, at, pos = [], 0, 0
    while at < len(words):
        room = SLACK
        for i in range(at, min(at + SKIP + 1, len(words))):
            n = 1 if len(words[i]) >= 4 else 2
            sought = "".join(words[i : i + n])
            hit = text.find(sought, pos, pos + room + len(sought)) if len(sought) >= 4 else -1
            if hit >= 0:
                found += range(i, min(i + n, len(words)))
                at, pos = i + n, hit + len(sought)
                break
            room += max(len(words[i]), SLACK)
        else:
            break
    return found


def verify(item: Item, codes: np.ndarray, hashes: np.ndarray, least_words: int) -> list[Verdict]:
    """Chains the runs that a stretch of a document shares with the item, in order and with little between them, and
    finds the item's passage that each chain holds, the best chain first and then those of the runs left: trimmed to where it is held well, and whole, its edges followed
    beyond edited words. Words count by how few items use them, so what items merely share with each other, or with
    texts built like them, makes no passage."""
    p, q = item.shared(hashes)
    if not len(p):
        return []
    order = np.lexsort((p, q - p))
    p, q = p[order], q[order]
    start = np.flatnonzero(np.r_[True, (np.diff(q - p) != 0) | (np.diff(p) != 1)])
    end = np.r_[start[1:], len(p)] - 1
    runs = sorted(zip(p[start].tolist(), q[start].tolist(), (p[end] - p[start] + GRAM).tolist(), strict=True))
    rp, rq, rl = (np.array(x) for x in zip(*runs, strict=True))
    score, back = rl.astype(float), np.full(len(runs), -1)
    for i in range(1, len(runs)):
        gap_p, gap_q = rp[i] - (rp[:i] + rl[:i]), rq[i] - (rq[:i] + rl[:i])
        lap = np.maximum(0, np.maximum(-gap_p, -gap_q))
        ok = (rp[:i] < rp[i]) & (rq[:i] < rq[i]) & (lap < rl[i])
        gain = np.where(ok, score[:i] - lap - 0.5 * np.maximum(np.maximum(gap_p, gap_q), 0) - 0.1 * np.abs(gap_p - gap_q), -1e9)
        j = int(np.argmax(gain))
        if gain[j] > 0:
            score[i] += gain[j]
            back[i] = j
    out, used = [], np.zeros(len(runs), bool)
    while not used.all():
        i = last = int(np.argmax(np.where(used, -1.0, score)))
        chain = []
        while i >= 0 and not used[i]:
            chain.append(i)
            i = back[i]
        used[chain] = True
        first = chain[-1]
        if 2 * (np.searchsorted(item.words, rq[last] + rl[last]) - np.searchsorted(item.words, rq[first], "right") + 1) < min(least_words, len(item.weight)):
            continue  # too few words for what may lie beyond its ends to make it a passage
        held = np.zeros(len(item.codes), bool)
        for i in chain:
            held[rq[i] : rq[i] + rl[i]] = True
        sums = np.r_[0, np.cumsum(held)]
        inside = (sums[item.words[1:]] - sums[item.words[:-1]]) >= 0.75 * np.diff(item.words)
        out += [trimmed(item, inside), whole(item, inside, codes, (rp[first], rq[first]), (rp[last] + rl[last], rq[last] + rl[last]))]
    return out


def whole(item: Item, inside: np.ndarray, codes: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> Verdict:
    """All words from the first to the last held one; ``start``, ``end``: of the chain, in the document and the item."""
    inside = inside.copy()
    if inside.any():
        # letters that a run shares by chance with an edited word may be the next word's
        after, before = int(np.searchsorted(item.words, end[1], "right")) - 1, int(np.searchsorted(item.words, start[1])) - 1
        lap_after, lap_before = int(end[1] - item.words[after]), int(item.words[before + 1] - start[1])
        if after < len(inside) and inside[after]:
            after, lap_after = after + 1, 0
        if before >= 0 and inside[before]:
            before, lap_before = before - 1, 0
        words = [spelled(item.codes[item.words[n] : item.words[n + 1]]) for n in range(after, min(after + 12, len(inside)))]
        for n in beyond(words, spelled(codes[end[0] - lap_after : end[0] + 200])):
            inside[after + n] = True
        words = [spelled(item.codes[item.words[n] : item.words[n + 1]][::-1]) for n in range(before, max(-1, before - 12), -1)]
        for n in beyond(words, spelled(codes[max(0, start[0] - 200) : start[0] + lap_before][::-1])):
            inside[before - n] = True
    told = np.flatnonzero(inside)
    if not len(told):
        return Verdict(len(inside), 0, 0, 0, 0.0, 0.0, True)
    return judged(item, inside, int(told[0]), int(told[-1]) + 1, True)


def trimmed(item: Item, inside: np.ndarray) -> Verdict:
    """The stretch of words with the greatest weight held, where a missing word takes back MISS times its own."""
    total = np.r_[0.0, np.cumsum(np.where(inside, item.weight, -MISS * item.weight))]
    low = np.minimum.accumulate(total)
    last = int(np.argmax(total - low))
    first = int(np.argmin(total[: last + 1]))
    return judged(item, inside, first, last, False)


def judged(item: Item, inside: np.ndarray, first: int, last: int, whole: bool) -> Verdict:
    """The verdict on the item's words ``first`` to below ``last``; where less than one is its own, that says nothing."""
    held, squares, own = inside[first:last], item.weight[first:last] ** 2, item.own[first:last]
    share = float(squares[held].sum() / squares.sum()) if last > first else 0.0
    return Verdict(len(inside), first, last - first, int(held.sum()), share, float(own[held].sum() / own.sum()) if own.sum() >= 1 else 1.0, whole)


def answered(answer: str, text: str) -> bool:
    """Whether a text has the answer's words, one after the other; of an answer of eight or more letters and digits,
    also its stream."""
    apart = lambda x: f" {' '.join(OTHER.split(plain(x))).strip()} "
    return bool(stream(answer).size) and (apart(answer) in apart(text) or (stream(answer).size >= 8 and spelled(stream(answer)) in spelled(stream(text))))


def leaks_of(text: str | None, index: Index, *, passage: int, threshold: float, least_words: int) -> list[tuple[int, int, int, int, bool]]:
    """``item_id, first word, words, words held, answer found`` of each leaked item's best passage."""
    codes = stream(text)
    hashes = grams(codes)
    terms = index.lookup(hashes)
    if not (terms >= 0).any():
        return []
    bound = np.r_[0.0, np.cumsum(np.where(terms >= 0, index.top[terms], 0.0))]
    found: dict[int, list[int]] = {}
    for a in range(0, len(terms), passage // 2):
        b = min(a + passage, len(terms))
        if bound[b] - bound[a] >= threshold:
            query = np.unique(terms[a:b])
            for n in index.above(query[query >= 0], threshold):
                found.setdefault(n, []).append(a)
        if b == len(terms):
            break
    out = []
    for n, starts in found.items():
        item, best = index.items[n], None
        reach = len(item.codes) * 3 // 2
        spans: list[list[int]] = []
        for a in starts:
            lo, hi = max(0, a - reach), min(len(hashes), a + passage + reach)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            for v in verify(item, codes[lo : hi + GRAM - 1], hashes[lo:hi], least_words):
                best = v if v.passes(least_words) and (best is None or v.length > best.length) else best
        if best:
            out.extend((i, best.first, best.length, best.held, answered(answer, text)) for i, answer in item.owners)
    return out


FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("item", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("words_held", T.LongType()), T.StructField("answer_found", T.BooleanType())])


def _used(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of each text, and its grams and pairs of words as numbers after ``#``, each once; an empty key has the
    number of grams."""
    for frame in frames:
        for text, block in zip(frame["text"], frame["block"], strict=True):
            hashes = grams(stream(text)).tolist()
            words = re.findall(r"[^\W_]+", plain(text))
            pairs = {p for apart in range(1, NEAR + 1) for p in word_pairs(word_hashes(words), apart).tolist()}
            keys = ["", *set(words), *(f"#{g}" for g in pairs.union(hashes))]
            yield pd.DataFrame({"block": block, "key": pd.Series(keys, dtype=object), "grams": [len(hashes)] + [0] * (len(keys) - 1)})


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str,
    text: str,
    item_id: str,
    item_text: str,
    item_answer: str,
    least_words: int = 25,
    passage: int = 200,
    threshold: float = 100.0,
    block_chars: int = 2_000_000,
) -> DataFrame:
    """``doc, item, first_word, words, words_held, answer_found`` for each document and item of which it holds a
    passage of at least ``least_words`` words, or all of a shorter item.

    Every whole text is searched in passages of ``passage`` characters at half that distance, against all items. The
    items are indexed in blocks of about ``block_chars`` characters; one index is broadcast at a time and bounded by
    that, and each further block is another pass over the documents; how rare words and
    grams are is counted over all items, so blocks give what one index would. ``answer_found`` tells whether the document has the answer, too; what counts as a leak is the text alone. A passage counts with up to two words less, as its edges may be
    edited, where most of its rarer words are held, and not at all where half of them aren't, see :class:`Verdict`. Null or empty texts hold nothing; items without seven letters or digits can't be found;
    repeated rows of an item are one; repeated documents each get their rows."""
    spark = docs.sparkSession
    told = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"), F.col(item_answer).alias("answer")).where("item is not null and text is not null").dropDuplicates(["item", "text"])
    told = told.groupBy("text").agg(F.collect_list(F.struct("item", "answer")).alias("owners"))
    blocks = max(1, -(-int(told.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    source = spread(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null"))
    placed = told.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    total = told.count() if blocks > 1 else None
    used = cut(placed.mapInPandas(_used, "block long, key string, grams long")) if blocks > 1 else None
    often = cut(used.where("key != ''").groupBy("key").count().where("count > 1")) if blocks > 1 else None
    mean = used.where(f"key = '' and grams > 0").agg(F.avg("grams")).first()[0] if blocks > 1 else None
    out = None
    for block in range(blocks):
        rows = [(o.item, r.text, o.answer) for r in placed.where(F.col("block") == block).collect() for o in r.owners]
        common = {(int(k[1:]) if k[0] == "#" else k): n for k, n in often.join(used.where(F.col("block") == block).select("key").distinct(), "key").collect()} if blocks > 1 else None
        index = spark.sparkContext.broadcast(Index.build(sorted(rows, key=lambda r: (r[0], r[1])), least_words=least_words, total=total, mean=mean, common=common))

        def search(frames: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = [(d, *x) for d, t in zip(frame["doc"].tolist(), frame["text"].tolist(), strict=True) for x in leaks_of(t, index.value, passage=passage, threshold=threshold, least_words=least_words)]
                yield pd.DataFrame(found, columns=FOUND.names)

        part = source.mapInPandas(search, FOUND)
        out = part if out is None else out.unionAll(part)
    return out
