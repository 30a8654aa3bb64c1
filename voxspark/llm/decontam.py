"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of marks; numbers, units and names become typed placeholders, so
that a question with other values has the same template. Names are the words that the benchmark writes
with a capital within a sentence, whatever their case in a document; documents are read a second time with
their own capitalised words as names too, which finds questions about other people and places. Windows of
template tokens are hashed. A Bloom filter of the benchmark's windows, sized by their number, passes over the documents; the
few windows that it lets through are joined by hash with those of the benchmark. Along each alignment
of a document with an item the slots are compared: values that map to one value each are a verbatim or a
re-parameterised copy; where a value maps to several, the placeholders matched by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .minhash import _hot as hot_keys
from .scratch import Scratch
from .words import WordTable, mix64, split_blocks, unicode_words_of

# Unit words that follow a number.
UNITS = frozenset("mm cm m km in ft mi mg g kg t lb oz ml l s ms min h hr hrs hours minutes seconds days weeks months years percent % $ € £ usd eur dollars euros cents degrees °c °f km/h mph v w kw kwh hz khz mhz ghz kb mb gb tb".split())

_NUMBER = re.compile(r"[+\-−]?[$€£]?\d+(?:[.,:/]\d+)*%?")
_MARKS = re.compile(r"^[\W_]+|[\W_]+$")
_ENDS = re.compile(r"[.!?:…]\W*$")
LITERAL, NUMBER, UNIT, NAME, NOTHING = range(5)
#: Bits of the flags beside a word's hash.
_TITLE, _END, _NUM, _UNIT, _EMPTY, _KNOWN = 1, 2, 4, 8, 16, 32
_FEATURE = np.dtype([("literal", "<u8"), ("flags", "<u1")])
HITS = "doc_id long, place long, width int, literal int, window long, slots array<string>"


def _feature(w: str) -> tuple[int, int]:
    """Hash of a word without marks and case, and its flags."""
    core = _MARKS.sub("", w)
    flags = _END if _ENDS.search(w) else 0
    if _NUMBER.fullmatch(w.strip("()[]{}\"'.,;!?#*&")) or core.isdigit():
        flags |= _NUM
    elif not core:
        flags |= _UNIT if w in UNITS else _EMPTY
    elif core.lower() in UNITS:
        flags |= _UNIT
    if core and core[0].isupper() and core[1:].islower():
        flags |= _TITLE
    return xxhash.xxh64_intdigest(core.lower().encode("utf-8", "surrogatepass")), flags


def _features(words: list[str], names: np.ndarray | None = None) -> np.ndarray:
    """Hash and flags of each word; ``names`` is the filter of known names."""
    out = np.zeros(len(words), _FEATURE)
    digest = xxhash.xxh64_intdigest
    literal, flags = [0] * len(words), [0] * len(words)
    for k, w in enumerate(words):
        # a word of letters, with a comma or a full stop at most: nothing else needs the patterns
        core = w if w.isalpha() else w[:-1] if w[-1] in ",." else ""
        if core.isalpha():
            low = core.lower()
            literal[k] = digest(low.encode())
            flags[k] = (_END if w[-1] == "." else 0) | (_UNIT if low in UNITS else 0) | (_TITLE if low != core and core[0].isupper() and core[1:].islower() else 0)
        else:
            literal[k], flags[k] = _feature(w)
    out["literal"], out["flags"] = literal, flags
    if names is not None and len(out):
        out["flags"] |= np.where(in_bloom(names, out["literal"]), _KNOWN, 0).astype("u1")
    return out


def template(row: np.ndarray, values: np.ndarray, capitals: bool = True, known: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template token hashes of a text, their kinds, and the place of each among its words.

    A unit is a unit word after a number. Names are ``known`` ones, and, with ``capitals``, title-case words that do not
    begin the text or follow the end of a sentence; words of marks alone vanish, but do not hide such an end.
    """
    return _read(_base(row, values), capitals, known)


def _base(row: np.ndarray, values: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """What all readings of a text share: literals and flags of its solid words, their places, which begin a sentence, numbers and units.

    ``row`` may hold several texts, which begin at ``starts`` and after each other.
    """
    f = values[row]
    empty = f["flags"] & _EMPTY != 0
    solid = np.flatnonzero(~empty) if empty.any() else np.arange(len(row))
    f = f[solid] if len(solid) < len(row) else f
    flags = f["flags"]
    if len(solid) < len(row):
        ends = np.concatenate([[0], np.cumsum(values["flags"][row] & _END != 0)])  # before each word
        fresh = np.concatenate([[True], ends[solid[1:]] > ends[solid[:-1]]])[: len(solid)]
    else:
        fresh = np.concatenate([[True], flags[:-1] & _END != 0])[: len(solid)]
    number = flags & _NUM != 0
    unit = flags & _UNIT != 0
    unit[1:] &= number[:-1]
    unit[:1] = False
    if starts is not None and len(solid):
        first = np.searchsorted(solid, starts)
        first = first[first < len(solid)]
        fresh[first], unit[first] = True, False
    return f["literal"], flags, solid, fresh, number, unit


def _read(base: tuple[np.ndarray, ...], capitals: bool, known: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    literal, flags, solid, fresh, number, unit = base
    kinds = np.full(len(solid), LITERAL)
    if known:
        kinds[flags & _KNOWN != 0] = NAME
    if capitals:
        kinds[(flags & _TITLE != 0) & ~fresh] = NAME
    kinds[unit] = UNIT
    kinds[number] = NUMBER
    return np.where(kinds == LITERAL, literal, kinds.astype(np.uint64)), kinds, solid


def windows(tokens: np.ndarray, kinds: np.ndarray, literals: np.ndarray, w: int, least: int = 0, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the windows of ``w`` tokens with ``least`` literal words, of those at ``places`` where given, and
    how many each has.

    A window of placeholders alone is like any other of its kinds, so it is hashed by its values (``literals``).
    """
    n = len(tokens) - w + 1
    if w < 1 or n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    n_literal = total[w:] - total[:-w]
    at = slice(0, n) if places is None else places[places < n]
    h = np.full(n if places is None else len(at), w, np.uint64)
    for i in range(w):
        h = mix64(h + tokens[i : i + n][at])
    places, n_literal = np.arange(n)[at], n_literal[at]
    bare = np.flatnonzero(n_literal == 0) if least == 0 else ()
    if len(bare):
        exact = np.full(len(bare), w, np.uint64)
        for i in range(w):
            exact = mix64(exact + mix64(literals[places[bare] + i] + tokens[places[bare] + i]))
        h[bare] = exact
    some = np.flatnonzero(n_literal >= least)
    return h[some], places[some], n_literal[some]


def own_windows(n_literal: np.ndarray, w: int, least_literal: int) -> np.ndarray:
    """Places of the windows that stand for an item: those with enough literal words; where it has none, those
    with a literal word; where it has none of these either, all."""
    for least in (min(least_literal, w), 1, 0):
        places = np.flatnonzero(n_literal >= least)
        if len(places):
            break
    return places


def _slots(words: list[str], row: np.ndarray, kinds: np.ndarray, solid: np.ndarray, place: int, w: int) -> list[str]:
    """Values of the placeholders of a window, each with its offset in it."""
    return [f"{i}|{_MARKS.sub('', words[row[solid[place + i]]]).lower()}" for i in range(w) if kinds[place + i] != LITERAL]


#: Bits of the filter for each window of the benchmark, and its least and largest size: 1 kB and 128 MB as it is broadcast.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 13, 30


def bloom_bits(n_windows: int) -> int:
    """Binary logarithm of the filter's size. A benchmark of more than 64 million windows lets more windows through, which the join drops."""
    return min(max((BITS_EACH * max(n_windows, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def in_bloom(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter, bytes of eight bits each."""
    mask = np.uint64(8 * len(bloom) - 1)

    def bit(at: np.ndarray) -> np.ndarray:
        return (bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1

    return (bit(h & mask) & bit((h >> np.uint64(32)) & mask)).astype(bool)


def _bloom(windows_of_items: DataFrame) -> np.ndarray:
    """The filter, sized by the number of windows. The driver gets its bits, 128 MB at most, in parts, never the windows."""
    bits = bloom_bits(windows_of_items.count())
    mask = (1 << bits) - 1
    slots = windows_of_items.select(F.explode(F.array(F.col("window").bitwiseAND(F.lit(mask)), F.shiftright("window", 32).bitwiseAND(F.lit(mask)))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    packed = np.zeros(1 << (bits - 5), "<u4")
    for r in words.toLocalIterator():
        packed[r["at"]] = r["bits"]
    return packed.view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, width: int = 5, least_literal: int = 3, coverage: float = 0.5) -> DataFrame:
    """``doc_id, item_id, coverage, kind, n_slots`` for each document of ``docs`` (doc_id, text) that holds an
    item of ``benchmark`` (item_id, text).

    An item is held when alignments with consistent slots cover ``coverage`` of its distinct windows. ``kind``
    is ``verbatim`` if all slot values agree, else ``reparameterised``. Letter case does not matter for verbatim copies;
    other names are told by their capitals, so a copy with other names in small letters is found by its other windows only.
    Null ids and null, empty or blank texts hold nothing; an item shorter than ``width`` words is one window, looked up at its
    own width in every text; an item of placeholders alone is held where its values are; texts of any length are whole; repeated
    rows do not count twice; other columns are left alone; an empty table gives an empty result.
    """
    # at most one row for each word of the benchmark
    asked = benchmark.select(F.col("item_id").alias("doc_id"), "text")
    context = docs.sparkSession.sparkContext
    names = context.broadcast(_bloom(scratch.keep(_names(asked), "names")))
    items = scratch.keep(_hits(asked, None, names, {width: 0}, least_literal), "items")
    # equal windows have equally many literal words; ``width`` rows at most
    widths = {r["width"]: r["least"] for r in items.groupBy("width").agg(F.min("literal").alias("least")).collect()}
    bloom = context.broadcast(_bloom(items))
    hits = scratch.keep(_hits(docs, bloom, names, widths, least_literal).drop("width", "literal"), "hits")
    item = items.select(F.col("doc_id").alias("item_id"), F.col("place").alias("item_place"), F.col("window").alias("of"), F.col("slots").alias("item_slots"))
    counts = scratch.keep(hits.groupBy(F.col("window").alias("key")).agg(F.count(F.lit(1)).alias("c")), "counts")
    distinct = scratch.keep(item.select("item_id", "of").distinct().join(counts, F.col("of") == F.col("key"), "left").select("item_id", "of", F.coalesce("c", F.lit(0)).alias("c")), "distinct")
    sizes = distinct.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    # whoever holds ``coverage`` of an item's windows holds one of its n - ceil(coverage * n) + 1 rarest: a window that
    # many documents and many items share brings no pair together
    rarest = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("item_id").orderBy("c", "of"))).join(sizes, "item_id")
    leads = rarest.filter((F.col("nth") <= F.col("n_windows") - F.ceil(F.col("n_windows") * coverage) + 1) & (F.col("c") > 0)).select("item_id", F.col("of").alias("lead"))
    # a window that very many documents hold is dealt in parts
    hot = F.broadcast(hot_keys(counts, scratch, hits.count()).select(F.col("key").alias("hot"), "parts"))
    leads = leads.join(hot, F.col("lead") == F.col("hot"), "left").select("item_id", "lead", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    dealt = hits.select("doc_id", "window").join(hot, F.col("window") == F.col("hot"), "left")
    dealt = dealt.select("doc_id", "window", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    pairs = dealt.join(leads, (F.col("window") == F.col("lead")) & (dealt["part"] == leads["part"])).select(F.col("doc_id").alias("holder"), "item_id").distinct()
    pairs = scratch.keep(pairs, "pairs")
    # the windows of a pair's document against those of its item: the pair is in the key, so none is hot
    asked = pairs.join(item, "item_id").select("holder", "item_id", "item_place", "of", "item_slots")
    met = scratch.keep(hits.join(asked, (F.col("doc_id") == F.col("holder")) & (F.col("window") == F.col("of"))).drop("holder", "of"), "met")

    aligned = met.withColumn("shift", F.col("place") - F.col("item_place"))
    run = ["doc_id", "item_id", "shift"]
    pair = aligned.select(*run, F.explode(F.arrays_zip("item_slots", "slots")).alias("slot"))
    value = lambda c: F.regexp_replace(c, r"^\d+\|", "")
    values = pair.select(*run, value(F.col("slot.item_slots")).alias("was"), value(F.col("slot.slots")).alias("now")).distinct()
    # a function of the item's values; two of them may become equal
    ways = values.groupBy(*run).agg(F.count(F.lit(1)).alias("n_slots"), F.count_distinct("was").alias("n_was"), F.sum((F.col("was") != F.col("now")).cast("int")).alias("changed"))
    # windows without slots count whatever the others of their run hold
    agrees = F.col("n_slots").isNull() | (F.col("n_slots") == F.col("n_was"))
    checked = aligned.join(ways, run, "left").filter(agrees | (F.size("slots") == 0))
    per_run = checked.groupBy(*run).agg(F.max(F.when(agrees, F.coalesce("n_slots", F.lit(0))).otherwise(0)).alias("n_slots"), F.max(F.coalesce("changed", F.lit(0))).alias("changed"))
    covered = checked.groupBy("doc_id", "item_id").agg(F.count_distinct("window").alias("n_met"))
    slots = per_run.groupBy("doc_id", "item_id").agg(F.sum("n_slots").alias("n_slots"), F.max("changed").alias("changed"))
    share = covered.join(sizes, "item_id").withColumn("coverage", F.col("n_met") / F.col("n_windows")).filter(F.col("coverage") >= coverage)
    kind = F.when(F.col("changed") > 0, "reparameterised").otherwise("verbatim")
    return share.join(slots, ["doc_id", "item_id"]).select("doc_id", "item_id", "coverage", kind.alias("kind"), F.col("n_slots").cast("long").alias("n_slots"))


def _names(benchmark: DataFrame) -> DataFrame:
    """``window``: hashes of the words that are capitalised within a sentence of the benchmark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(_features)
        for frame in frames:
            for _, words in split_blocks(frame, unicode_words_of):
                rows, values = table.look_up(words)
                found = [np.zeros(0, np.uint64)]
                for row in rows:
                    _, kinds, solid = template(row, values, known=False)
                    found.append(values["literal"][row[solid[kinds == NAME]]])
                yield pd.DataFrame({"window": np.unique(np.concatenate(found)).view(np.int64)})

    return benchmark.select("text").mapInPandas(run, "window long").distinct()


def _hits(docs: DataFrame, bloom, names, widths: dict[int, int], least_literal: int) -> DataFrame:
    """Windows of ``docs`` of all ``widths``, each with its least number of literal words, that the broadcast filter lets through; without one, the windows that
    stand for each text, of the one width or the text's own where that is less."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = bloom.value if bloom is not None else None
        for frame in frames:
            for part, words in split_blocks(frame, unicode_words_of):
                # most distinct words of a block are new, so no table of them is kept
                coded = words.flatten().dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                starts = words.offsets.to_numpy() - words.offsets[0].as_py()
                yield _found(part["doc_id"], distinct, coded.indices.to_numpy(), starts, _features(distinct, names.value), widths, least_literal, held)

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, HITS)


def _found(ids, names: list[str], row: np.ndarray, starts: np.ndarray, values: np.ndarray, widths: dict[int, int], least_literal: int, held: np.ndarray | None) -> pd.DataFrame:
    """Windows of texts, whose words are ``names`` by ``row`` and which begin at ``starts``: with the filter ``held`` those it lets through, of all texts together; else the windows that stand for each text."""
    out = []
    columns = ["doc_id", "place", "width", "literal", "window", "slots"]
    if held is None:
        for doc_id, a, b in zip(ids, starts, starts[1:]):
            own = row[a:b]
            tokens, kinds, solid = template(own, values, capitals=False)
            for w, least in widths.items():
                w = min(w, len(tokens))
                h, places, n_literal = windows(tokens, kinds, values["literal"][own[solid]], w, least)
                if len(h):
                    kept = own_windows(n_literal, w, least_literal)
                    out += [(doc_id, int(p), w, int(n), x, _slots(names, own, kinds, solid, p, w)) for p, n, x in zip(places[kept], n_literal[kept], h[kept].view(np.int64).tolist())]
        return pd.DataFrame(out, columns=columns)
    ids = ids.tolist()
    base = _base(row, values, starts[:-1])
    literals, solid = base[0], base[2]
    owner = np.searchsorted(starts, solid, "right") - 1
    first = np.searchsorted(solid, starts)
    plain = _read(base, False, True)
    readings = [(plain, None)]
    # words that a text alone writes as names
    if ((base[1] & (_TITLE | _KNOWN) == _TITLE) & ~base[3]).any():
        marked = _read(base, True, True)
        readings.append((marked, np.flatnonzero(plain[1] != marked[1])))
    for (tokens, kinds, _), other in readings:
        for w, least in widths.items():
            # the second reading differs in the windows that hold one of its own names
            near = None if other is None else np.unique(np.concatenate([other - i for i in range(w)]))
            h, places, n_literal = windows(tokens, kinds, literals, w, least, near if near is None else near[near >= 0])
            kept = np.flatnonzero(in_bloom(held, h))
            kept = kept[owner[places[kept]] == owner[places[kept] + w - 1]]  # a window lies in one text
            out += [(ids[d], int(p - first[d]), w, int(n), x, _slots(names, row, kinds, solid, p, w)) for d, p, n, x in zip(owner[places[kept]].tolist(), places[kept], n_literal[kept], h[kept].view(np.int64).tolist())]
    return pd.DataFrame(out, columns=columns)
