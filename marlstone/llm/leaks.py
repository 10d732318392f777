"""Problem 7: evaluation passages in training text, by spaced-seed hashing.

Both sides become streams of tokens from which case, punctuation, width, line layout, mark-up and invisible characters are
gone: words where words are spaced, characters where they are not. Fixed masks pick some positions of a short window and
ignore the others; the hash of the picked tokens joins item and document positions. Around the hits the overlap is verified:
a passage of at least 20 consecutive words of the item (60 characters), at most one in ten of them changed.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Masks of the seeds; 1 takes part, 0 is ignored.
WORD_MASKS = ("111111", "11101011")
CHAR_MASKS = ("1111111", "1110110111")
#: (shortest passage, shift of the diagonal that changes may bring, weight of the first mask). A passage of 10 k words with k
#: of them changed keeps 9 k in at most k + 1 runs, so at least 9 k - (w - 1)(k + 1) seeds of w unbroken words, whatever the
#: changes do to the number of words; a longer passage holds one of 10 k or two halves of which one is a passage. So of the
#: lengths 10 k from the shortest up to less than twice that, one has its seeds (``_needs``): for words 3 seeds within 20 or
#: 7 within 30, for characters 12 within 60, 15 within 70, up to 27 within 110.
WORD_RULE, CHAR_RULE = (20, 12, 6), (60, 40, 7)
BLOCK_ITEMS = 4000


def _needs(rule: tuple[int, int, int]) -> list[tuple[int, int]]:
    """(seeds, units): a passage has that many seeds within that many units of the item, for one of these."""
    least, _, weight = rule
    return [(9 * k - (weight - 1) * (k + 1), 10 * k) for k in range(least // 10, least // 5)]

_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3005\u0e00-\u0e7f\u0e80-\u0eff\u1000-\u109f\u1780-\u17ff]")
# A tag with well-written attributes may have any length; a sloppier one is told from a comparison by its shortness.
_TAG = re.compile(r"""</?[a-zA-Z][\w:.-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>"']++))?+)*+\s*+/?+>|</?[a-zA-Z][^<>]{0,200}>""")
_ENTITY = re.compile(r"&(?:#\d|#[xX]|[a-zA-Z]{2})")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]")
_BROKEN = re.compile(r"([^\W_]+)[-‐‑]\s*\n[ \t]*(?:(?://+|#+|[>*%;]|--)[ \t]*)?([^\W_]+)")
_BREAK = re.compile(r"[-‐‑]\s*\n")
_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BITS = 20


def _without_comments(text: str) -> str:
    parts, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        parts.append(text[at:begin])
        at = end + 3
    return "".join([*parts, text[at:]])


def plain(text: str) -> str:
    """The text without mark-up, invisible characters, width and case."""
    if _ENTITY.search(text):
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _without_comments(text) if "<!--" in text else text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return text.casefold()


class Stream(NamedTuple):
    """Items of one kind. tokens: all items one behind the other, each followed by 0; unit: the word of each token, -1 where
    it counts for nothing; hashes of each mask, sorted, with the place of the seed; bits: a filter over the hashes."""

    masks: tuple[str, ...]
    rule: tuple[int, int, int]
    ids: list[int]
    starts: np.ndarray
    tokens: np.ndarray
    unit: np.ndarray
    hashes: list[np.ndarray]
    places: list[np.ndarray]
    bits: list[np.ndarray]


class Index(NamedTuple):
    vocabulary: dict[str, int]
    words: Stream
    chars: Stream


def _seed_hashes(tokens: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window and whether all its picked tokens are known (not 0)."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total, known = np.zeros(n, np.uint64), np.ones(n, bool)
    wide = tokens.astype(np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            part = wide[k : k + n]
            total = total * np.uint64(0x9E3779B97F4A7C15) + part * _FACTORS[k]
            known &= part != 0
    total ^= total >> np.uint64(29)
    return total * _FACTORS[63], known


def _stream(ids: list[int], parts: list[np.ndarray], units: list[np.ndarray], masks: tuple[str, ...], rule: tuple[int, int, int]) -> Stream:
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    tokens = np.concatenate([x for p in parts for x in (p, [0])] or [np.zeros(0)]).astype(np.uint32)
    unit = np.concatenate([x for u in units for x in (u, [-1])] or [np.zeros(0)]).astype(np.int64)
    hashes, places, bits = [], [], []
    for mask in masks:
        h, known = _seed_hashes(tokens, mask)
        at = np.flatnonzero(known)
        at = at[unit[at] >= 0]
        order = np.argsort(h[at], kind="stable")
        hashes.append(h[at][order])
        places.append(at[order])
        table = np.zeros(1 << _BITS, bool)
        table[h[at] >> np.uint64(64 - _BITS)] = True
        bits.append(table)
    return Stream(masks, rule, ids, starts, tokens, unit, hashes, places, bits)


def _opening(text: str) -> str:
    """The first line or sentence."""
    m = re.match(r"\s*(.*?(?:[.?!:](?=\s)|[。？！]|\n|\Z))", text, re.DOTALL)
    return m[1]


def build_index(items: Iterable[tuple[int, str]], instructions: Counter | None = None) -> Index:
    """The seeds of the items. An opening line or sentence that several items share is an instruction, not evaluation text."""
    items = [(i, t) for i, t in items if t is not None and i is not None]
    shared = instructions if instructions is not None else opening_counts(items)
    vocabulary: dict[str, int] = {}
    kinds: tuple[list, list] = ([], [])
    for key, text in items:
        skip = _opening(text) if shared[_opening_key(text)] > 1 else ""
        head = len("".join(_WORD.findall(plain(skip))))
        clean = plain(text)
        stream = "".join(_WORD.findall(clean))
        if len(_UNSPACED.findall(stream)) > 0.15 * len(stream):
            unit = np.arange(len(stream))
            unit[:head] = -1
            kinds[1].append((key, np.frombuffer(stream.encode("utf-32-le"), dtype=np.uint32), unit))
            continue
        tokens, unit, seen, number = [], [], 0, -1
        for word in clean.split():
            pieces = _WORD.findall(word)
            number += bool(pieces)
            for p in pieces:
                tokens.append(vocabulary.setdefault(p, len(vocabulary) + 1))
                unit.append(number if seen >= head else -1)
                seen += len(p)
        kinds[0].append((key, np.array(tokens, dtype=np.uint32), np.array(unit, dtype=np.int64)))
    words, chars = ([list(x) for x in zip(*k, strict=True)] or [[], [], []] for k in kinds)
    return Index(vocabulary, _stream(*words, WORD_MASKS, WORD_RULE), _stream(*chars, CHAR_MASKS, CHAR_RULE))


def opening_counts(items: Iterable[tuple[int, str]]) -> Counter:
    """How many different items open with the same line or sentence."""
    return Counter(_opening_key(t) for t in {t for _, t in items})


def _opening_key(text: str) -> str:
    return " ".join(_WORD.findall(plain(_opening(text))))


def _with_openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_opening_key(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], names=["_text", "_opening"])


def _verified(doc: np.ndarray, item: np.ndarray, unit: np.ndarray, hits: np.ndarray, rule: tuple[int, int, int]) -> bool:
    """Whether the document has a passage of the item near the hits (place in the item, place in the document), whose
    diagonals lie within one window."""
    least, shift, _ = rule
    diagonals = hits[:, 1] - hits[:, 0]
    own = np.unique(diagonals)
    a, b = max(0, int(hits[:, 0].min()) - 4 * least), min(len(item), int(hits[:, 0].max()) + 4 * least)
    part, number = item[a:b], unit[a:b]
    low, spaced = int(own[0]) - shift // 2, shift < 20
    across = int(own[-1]) + shift // 2 - low + 1
    # one row for each diagonal; beyond the ends of the document stand zeros, which no item holds
    beside = np.zeros(len(part) + across - 1, doc.dtype)
    lo, hi = max(0, a + low), min(len(doc), a + low + len(beside))
    beside[lo - a - low : max(lo, hi) - a - low] = doc[lo : max(lo, hi)]
    eq = np.lib.stride_tricks.sliding_window_view(beside, len(part)) == part
    width = 3 if spaced else 4  # shorter runs off the diagonals of the seeds are chance, as are those of letters
    same = eq[own - low].any(axis=0) if spaced else np.zeros(len(part), bool)
    if len(part) >= width:
        run = np.logical_and.reduce([eq[:, j : len(part) - width + 1 + j] for j in range(width)]).any(axis=0)
        for j in range(width):
            same[j : len(part) - width + 1 + j] |= run
    counts = number >= 0
    if not counts.any():
        return False
    first = number[counts].min()
    total = np.bincount(number[counts] - first)
    kept = np.bincount(number[counts] - first, same[counts])
    if a > 0 and unit[a - 1] == number[0] >= 0:
        kept[number[0] - first] = -1
    good = (kept == total) & (total > 0)
    n = len(good)
    if n < least:
        return False
    f = np.arange(n + 1) - 10 * np.concatenate([[0], np.cumsum(~good)])
    open_at = np.where(good, f[:-1], 1 << 30)
    lowest = np.minimum.accumulate(open_at)[: n - least + 1]
    return bool(((f[least:] >= lowest) & good[least - 1 :]).any())


def _hits(stream: Stream, tokens: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """(place among the tokens, place among the items' tokens) of all equal seeds of one mask."""
    hashes, places, bits = stream.hashes[which], stream.places[which], stream.bits[which]
    h, known = _seed_hashes(tokens, stream.masks[which])
    at = np.flatnonzero(known & bits[h >> np.uint64(64 - _BITS)])
    left, right = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
    n = right - left
    return np.repeat(at, n), places[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _windows(group: np.ndarray, place: np.ndarray, stream: Stream) -> np.ndarray:
    """The groups whose distinct seeds stand as close as those of a passage."""
    if not len(group):
        return group
    order = np.lexsort((place, group))
    group, place = group[order], place[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (place[1:] != place[:-1])
    group, place = group[fresh], place[fresh]
    begin, end = stream.unit[place], stream.unit[place + stream.rule[2] - 1]
    found = []
    for seeds, units in _needs(stream.rule):
        if len(group) >= seeds:
            last = slice(seeds - 1, None)
            near = (group[last] == group[: len(group) - seeds + 1]) & (end[last] - begin[: len(group) - seeds + 1] < units)
            found.append(group[last][near])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _matches(stream: Stream, tokens: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """(number of the document, number of the item) of every verified pair. ``tokens`` holds the documents one behind the
    other, each followed by 0; document k begins at begins[k]."""
    if not len(tokens) or not any(map(len, stream.hashes)):
        return
    shift = stream.rule[1]
    longest = int(np.diff(stream.starts).max())
    bands = (len(tokens) + 2 * longest) // shift + 2

    def placed(doc_at: np.ndarray, item_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        doc, item = np.searchsorted(begins, doc_at, "right") - 1, np.searchsorted(stream.starts, item_at, "right") - 1
        local, inside = doc_at - begins[doc], item_at - stream.starts[item]
        return doc.astype(np.int64) * len(stream.ids) + item, local, inside, (local - inside + longest) // shift

    doc_at, item_at = _hits(stream, tokens, 0)
    pair, _, _, band = placed(doc_at, item_at)
    _, number, times = np.unique(pair, return_inverse=True, return_counts=True)
    often = times[number] >= _needs(stream.rule)[0][0]
    doc_at, item_at, pair, band = doc_at[often], item_at[often], pair[often], band[often]
    # every two neighbouring bands of diagonals are a window, so a passage lies whole in one
    group = np.concatenate([pair * bands + band, pair * bands + np.maximum(band - 1, 0)])
    windows = _windows(group, np.concatenate([item_at, item_at]), stream)
    if not len(windows):
        return
    some = np.isin(pair, np.unique(windows // bands))
    rows = [(doc_at[some], item_at[some])]
    ends = np.concatenate([begins[1:], [len(tokens)]])
    for d in np.unique(windows // bands // len(stream.ids)).tolist():
        for which in range(1, len(stream.masks)):
            near, item_at = _hits(stream, tokens[begins[d] : ends[d]], which)
            rows.append((near + begins[d], item_at))
    pair, local, inside, band = placed(*(np.concatenate(x) for x in zip(*rows, strict=True)))
    order = np.lexsort((band, pair))
    key, local, inside = (pair * bands + band)[order], local[order], inside[order]
    done = -1
    for window in windows.tolist():
        own = window // bands
        if own == done:
            continue
        d, i = divmod(own, len(stream.ids))
        a, b = np.searchsorted(key, [window, window + 2])
        hits = np.stack([inside[a:b], local[a:b]], axis=1)
        its = slice(int(stream.starts[i]), int(stream.starts[i + 1]) - 1)
        if _verified(tokens[int(begins[d]) : int(ends[d]) - 1], stream.tokens[its], stream.unit[its], hits, stream.rule):
            done = own
            yield d, i


def _tokens(texts: list[str | None], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Word tokens and their beginnings, character tokens and theirs, and the numbers of the texts that have characters of
    unspaced scripts."""
    known = index.vocabulary.get

    def joined(m: re.Match) -> str:
        whole = m[1] + m[2]
        return whole if whole in index.vocabulary else f"{m[1]} {m[2]}"

    words: list[int] = []
    begins: list[int] = []
    chars: list[np.ndarray] = []
    char_begins: list[int] = []
    unspaced: list[int] = []
    zero, size = np.zeros(1, np.uint32), 0
    for n, text in enumerate(texts):
        begins.append(len(words))
        if text:
            clean = plain(text)
            if _BREAK.search(clean):
                clean = _BROKEN.sub(joined, clean)
            found = _WORD.findall(clean)
            words += [known(w, 0) for w in found]
            if index.chars.ids and not clean.isascii() and _UNSPACED.search(clean):
                stream = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                unspaced.append(n)
                char_begins.append(size)
                chars += [stream, zero]
                size += len(stream) + 1
        words.append(0)
    return np.array(words, np.uint32), np.array(begins, np.int64), np.concatenate(chars) if chars else np.zeros(0, np.uint32), np.array(char_begins, np.int64), unspaced


def leaked_items(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """``item_id, doc_id``: every document with a passage of an item, once.

    The seeds of at most ``block`` items are sent to all executors at a time; a larger set of items is worked off in such
    blocks, each against all documents, so neither side is cut short. Documents are never shuffled. Null and empty texts on
    either side match nothing, as does an item with fewer than 20 words (60 characters); repeated rows count once; an item
    under several ids is reported under each.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item_key).cast("long").alias("_item"), F.col(text).alias("_text")).filter("_item is not null and _text is not null").distinct()
    known = rows.select("_text").distinct().mapInArrow(_with_openings, "_text string, _opening string")
    shared = known.groupBy("_opening").agg(F.count(F.lit(1)).alias("_n"))
    flagged = rows.join(known, "_text").join(shared, "_opening").select("_item", "_text", (F.col("_n") > 1).alias("_shared")).orderBy("_item", "_text")
    schema = f"{item_key} bigint, {doc_key} bigint"
    source = documents.select(F.col(doc_key).cast("long").alias(doc_key), F.col(text).alias(text)).filter(F.length(F.col(text)) > 0)

    def blocks() -> Iterator[list]:
        rest = flagged.toLocalIterator()
        while part := list(islice(rest, block)):
            yield part

    out = spark.createDataFrame([], schema)
    for n, part in enumerate(blocks()):
        openings = Counter({_opening_key(r["_text"]): 2 for r in part if r["_shared"]})
        sent = spark.sparkContext.broadcast(build_index([(r["_item"], r["_text"]) for r in part], openings))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index: Index = sent.value
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                at, doc_ids, item_ids = 0, [], []
                while at < len(texts):  # pieces of some two million characters bound the arrays
                    end, size = at, 0
                    while end < len(texts) and (end == at or size < 2_000_000):
                        size += len(texts[end] or "")
                        end += 1
                    words, begins, chars, char_begins, unspaced = _tokens(texts[at:end], index)
                    for d, i in _matches(index.words, words, begins):
                        doc_ids.append(keys[at + d])
                        item_ids.append(index.words.ids[i])
                    if unspaced:
                        for d, i in _matches(index.chars, chars, char_begins):
                            doc_ids.append(keys[at + unspaced[d]])
                            item_ids.append(index.chars.ids[i])
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(item_ids, pa.int64()), pa.array(doc_ids, pa.int64())], names=[item_key, doc_key])

        found = source.mapInArrow(run, schema)
        out = found if n == 0 else out.unionByName(found)
    return out.distinct()
