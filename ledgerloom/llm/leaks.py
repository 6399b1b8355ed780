"""Finding held-out evaluation passages in a large corpus by greedy string tiling.

Documents and items become words without case, marks and layout, as numbers, in the JVM. Runs of SEED words that both
have propose (document, item) pairs by a join; a pair goes on if its seeds cover as many of the item's words, in
whatever order, as any reportable match must, so nothing is lost there. Greedy string tiling then marks the longest
non-overlapping matches of each pair, found with running Karp-Rabin hashes, and the tiles decide: a passage of at least
PASSAGE consecutive item words, most of them matched, or an item covered nearly whole in whatever order.

Seeds of the items are broadcast up to a bound of their number and joined by shuffle beyond it. The corpus is read once
for the seeds and once more for the documents that met an item.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import ship, written

#: Words of a seed and of the shortest tile: every tile holds a seed.
SEED = TILE = 3
#: Shortest passage and least share of matched words in it; share of a whole item in any order.
PASSAGE, MATCHED, WHOLE = 20, 0.8, 0.85
#: Words between two tiles of one passage, at most.
GAP = 3
#: Bits of an item's positions that a pair keeps.
CELLS = 256
#: Seeds of items, and ids of documents that met one, up to which they are broadcast (about 40 bytes each).
BROADCAST_SEEDS = 1_000_000

RESULT = "doc_id bigint, item_id bigint, passage_words int, matched_words int, item_words int, tiles int"


def _plain_letters() -> tuple[str, str]:
    """Letters and digits with accents or of other widths, and the plain ones they stand for."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)):
        base = [c for c in unicodedata.normalize("NFKD", chr(point).lower()) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(point):
            pairs.append((chr(point), base[0]))
    return "".join(p for p, _ in pairs), "".join(p for _, p in pairs)


def words_of(text: Column) -> Column:
    """Words as white space parts them, folded and stripped of marks; parts of marks only are no words."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^<>\n]{1,60}>|&[a-z]{2,6};", " ")
    plain = F.translate(F.lower(plain), *_plain_letters())
    plain = F.regexp_replace(plain, r"(?U)[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != "")


def _numbers(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(numbers: Column) -> Column:
    """Hash of the run of SEED words at each position."""
    last = F.size(numbers) - SEED
    at = lambda i: F.xxhash64(*(F.get(numbers, i + k) for k in range(SEED)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of all runs of ``n`` ids."""
    if len(ids) < n:
        return np.empty(0, dtype=np.uint64)
    base = np.uint64(1_000_003)
    with np.errstate(over="ignore"):
        out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * base + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
    return out


def tile(a, b, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first, no word of either side used twice."""
    x, y = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    used_x, used_y = np.zeros(len(x), dtype=bool), np.zeros(len(y), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(x), len(y), 32))
    while True:
        where: dict[int, list[int]] = defaultdict(list)
        hashes_y, hashes_x = _rolling(y, size), _rolling(x, size)
        for j, h in enumerate(hashes_y.tolist()):
            where[h].append(j)
        shared = np.flatnonzero(np.isin(hashes_x, hashes_y))
        spots = list(zip(shared.tolist(), hashes_x[shared].tolist()))
        while True:
            best: dict[int, list[tuple[int, int]]] = defaultdict(list)
            ends: dict[int, int] = {}
            for i, h in spots:
                for j in where[h]:
                    if ends.get(i - j, -1) > i or used_x[i] or used_y[j]:
                        continue
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and not used_x[i + n] and not used_y[j + n]:
                        n += 1
                    if n >= size:
                        best[n].append((i, j))
                        ends[i - j] = i + n
            marked = False
            for n in sorted(best, reverse=True):
                for i, j in best[n]:
                    if not used_x[i : i + n].any() and not used_y[j : j + n].any():
                        used_x[i : i + n] = True
                        used_y[j : j + n] = True
                        tiles.append((i, j, n))
                        marked = True
            if not marked:
                break
        if size == least:
            return tiles
        size = max(least, size // 2)


def best_passage(tiles: list[tuple[int, int, int]], details: list[bool], gap: int = GAP) -> tuple[int, int]:
    """(item words spanned, item words matched) of the best run of tiles that follow each other in both texts.

    Tiles join where at most ``gap`` words lie between them on either side and none of the item's is a detail (a word
    with a digit): the same sentence about another amount, day or reference is no copy. Among runs matched well enough
    the longest counts.
    """
    rest = sorted(tiles, key=lambda t: t[1])
    best = (0, 0)
    for k, (i, j, n) in enumerate(rest):
        end_i, end_j, got = i + n, j + n, n
        if (n, n) > best:
            best = (n, n)
        for i2, j2, n2 in rest[k + 1 :]:
            if j2 - end_j > gap or any(details[end_j:j2]):
                break
            if 0 <= i2 - end_i <= gap and j2 >= end_j:
                end_i, end_j, got = i2 + n2, j2 + n2, got + n2
                span = end_j - j
                if got >= MATCHED * span and (span, got) > best:
                    best = (span, got)
    return best


def is_leak(span: int, got: int, covered: int, size: int) -> bool:
    """A passage may begin or end with an altered word, which no tile shows; a short item must be there nearly whole."""
    return span >= min(PASSAGE - 1, size * WHOLE) and got >= MATCHED * span or covered >= WHOLE * size


def may_leak(bits: int, size: int, details: list[int], width: int = 1) -> bool:
    """Whether seeds at these item positions leave room for a leak; every tile's words are covered by seeds inside it.

    ``bits`` has a bit for each ``width`` positions at which a seed begins. Either the seeds cover nearly the whole
    item, in whatever order, or there is a stretch of the item long enough for a passage, with gaps as tiles may have,
    and covered well enough. Words that are details (positions) and are not covered end a stretch, as they do for tiles.
    """
    need = min(PASSAGE - 1, size * WHOLE)
    start = end = got = total = 0
    room = False
    while bits:
        low = bits & -bits
        bits ^= low
        at = (low.bit_length() - 1) * width
        to = min(size, at + width - 1 + SEED)
        total += to - max(end, at)
        if not got or at - end > GAP or any(end <= d < at for d in details):
            start, got = at, to - at
        else:
            got += to - max(end, at)
        end = to
        room |= end - start >= need and got >= MATCHED * need
    return room or total >= WHOLE * size


def candidates(docs: DataFrame, items: DataFrame, bound: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id) whose common seeds leave room for a leak. Inputs have their words as ``numbers``.

    The positions at which a document meets an item are kept as CELLS bits; items of more words than that share bits
    between neighbours, which lets more through and loses nothing.
    """
    own = items.select("item_id", F.posexplode(_seeds(F.col("numbers"))).alias("at", "seed"))
    few = own.limit(bound + 1).count() <= bound
    longest = items.agg(F.max(F.size("numbers"))).first()[0] or 1
    width = -(-longest // CELLS)
    # A document's seeds are distinct, so each position of an item is met once.
    met = docs.select("doc_id", F.explode(F.array_distinct(_seeds(F.col("numbers")))).alias("seed")).join(F.broadcast(own) if few else own, "seed")
    cell = F.floor(F.col("at") / width)
    mask = lambda k: F.bit_or(F.when(F.floor(cell / 64) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (cell % 64).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}")
    masks = [f"m{k}" for k in range(min(CELLS, longest) // 64 + 1)]
    pair = met.groupBy("doc_id", "item_id").agg(*(mask(k) for k in range(len(masks))))
    least = F.least(F.lit(MATCHED * (PASSAGE - 1)), F.col("size") * F.lit(MATCHED * WHOLE))
    spots = F.filter(F.transform("details", lambda x, k: F.when(x, k)), lambda k: k.isNotNull())
    sizes = items.select("item_id", F.size("numbers").alias("size"), spots.alias("spots"))
    # Words that the seeds cover: each bit and its two successors, some of which lie in the next mask.
    over = [F.lit(0).cast("bigint"), *(F.shiftrightunsigned(m, 62) for m in masks[:-1])]
    wide = [F.col(m).bitwiseOR(F.shiftleft(m, 1)).bitwiseOR(F.shiftleft(m, 2)).bitwiseOR(o).bitwiseOR(F.shiftrightunsigned(o, 1)) for m, o in zip(masks, over)]
    covered = sum((F.bit_count(w) for w in wide[1:]), F.bit_count(wide[0])) * width
    pair = pair.join(sizes, "item_id").where(covered >= least)

    @F.pandas_udf("boolean")
    def room(held: pd.Series, sizes: pd.Series, at: pd.Series) -> pd.Series:
        whole = (sum((int(m) & (1 << 64) - 1) << 64 * k for k, m in enumerate(ms)) for ms in held)
        return pd.Series([may_leak(b, n, d.tolist(), width) for b, n, d in zip(whole, sizes, at)], dtype="bool")

    return pair.where(room(F.array(*masks), "size", "spots")).select("doc_id", "item_id")


def find_leaks(documents: DataFrame, items: DataFrame, bound: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per (doc_id, item_id) whose document carries the item or a long passage of it.

    Nulls: documents or items without id or text carry nothing. Empty texts have no words. Repeated items or documents
    (same id) count once. Long texts are read whole. Items shorter than PASSAGE words must be there nearly whole, and
    items or matches shorter than a seed are no leaks.
    """
    ship(documents.sparkSession)
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    numbers = _numbers(words_of(F.col("text")))
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    words = rows.select("item_id", words_of(F.col("text")).alias("w"))
    own = words.select("item_id", _numbers(F.col("w")).alias("numbers"), F.transform("w", lambda w: F.regexp_like(w, F.lit(r"\p{N}"))).alias("details"))
    pairs = written(candidates(texts.select("doc_id", numbers.alias("numbers")), own, bound), "pairs")
    met = pairs.select("doc_id").distinct()
    # Only documents that met an item are read into words again.
    full = texts.join(F.broadcast(met) if pairs.limit(bound + 1).count() <= bound else met, "doc_id").select("doc_id", numbers.alias("doc"))
    full = full.join(pairs, "doc_id").join(own.withColumnRenamed("numbers", "item"), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, item_id, doc, item, details in zip(b["doc_id"], b["item_id"], b["doc"], b["item"], b["details"]):
                tiles = tile(doc, item)
                span, got = best_passage(tiles, list(details))
                covered = sum(n for _, _, n in tiles)
                if is_leak(span, got, covered, len(item)):
                    out.append((doc_id, item_id, span, covered, len(item), len(tiles)))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in RESULT.split(", ")])

    found = full.select("doc_id", "item_id", "doc", "item", "details").mapInPandas(run, RESULT)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("passage_words", "matched_words", "item_words", "tiles")))
