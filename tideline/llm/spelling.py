"""Spelling variants of a corpus: words that differ by one inserted, deleted or replaced letter.

Such a pair agrees exactly in the first or in the last half of either word. So words are dealt out by their halves, to groups of
about BUCKET rows: in each a minimal acyclic automaton of its words (of reversed words for the last halves) walks a word's half
exactly and completes the rest with one error. Automata number their words, in order, by the words that
branch off before (perfect hashing); numbers name counts and drop what is found twice in a group, and of pairs found both ways
only the forward ones are kept.

Scale: words are counted slab by slab inside tasks before they are shuffled. A half that more than BUCKET words share is
split: its words into blocks, each with an automaton of its own, and its questions into as many chunks; every chunk meets every block, so
no group outgrows a task and no pair is lost. Links are pre-aggregated by word; forms are followed to their ends by doubling."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import durable, release

LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Rows of a group, words and questions together.
BUCKET = 1 << 16
_LONG = 64  # bytes; the checksums of longer runs are computed one by one
_DROP = 199
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True  # U+00C0 to U+00FF begin with C3 in UTF-8, and nothing else does
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1))


def crc32_spans(body, starts, ends, seeds):
    """The CRC-32 of each span of bytes, carried on from the checksum of what stands before it."""
    c = seeds.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    length = ends - starts
    order = np.argsort(-np.minimum(length, _LONG + 1), kind="stable")
    order = order[np.searchsorted(-length[order], -_LONG, "left") :] if (length > _LONG).any() else order
    at, state, left = starts[order], c[order], length[order]
    for j in range(int(left[0]) if len(left) else 0):
        k = np.searchsorted(-left, -j, "left")  # spans with more than j bytes
        state[:k] = _CRC[(state[:k] ^ body[at[:k] + j]) & np.uint32(0xFF)] ^ (state[:k] >> np.uint32(8))
    c[order] = state
    c ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(length > _LONG).tolist():
        c[k] = zlib.crc32(body[starts[k] : ends[k]].tobytes(), int(seeds[k]))
    return c


def _strings(body, starts, ends):
    """The spans as an array of strings."""
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    mark = np.zeros(len(body) + 1, np.int8)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    inside = body[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(inside)))


def _runs(least):
    """Arrow mapper: (id as text, text) to words of at least `least` letters and their counts, slab by slab."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, body, offsets in tk.slabs(batch.column(1)):
                letter = _LETTER[body]
                letter[1:] |= body[:-1] == 0xC3
                cut = np.zeros(len(body) + 1, bool)
                cut[offsets] = True
                starts = np.flatnonzero(letter & (np.r_[True, ~letter[:-1]] | cut[:-1]))
                ends = np.flatnonzero(letter & (np.r_[~letter[1:], True] | cut[1:])) + 1
                lead = np.r_[0, np.cumsum((body & 0xC0) != 0x80)]
                keep = lead[ends] - lead[starts] >= least
                starts, ends = starts[keep], ends[keep]
                if not len(starts):
                    continue
                body = tk._LOWER[body]
                seeds = np.array([zlib.crc32(f"{ids[lo + k]}:".encode()) for k in range(len(offsets) - 1)], np.uint32)
                h = crc32_spans(body, starts, ends, seeds[np.searchsorted(offsets, starts, "right") - 1])
                odd = h % np.uint32(_DROP) == 0
                words = [_strings(body, starts[~odd], ends[~odd])]
                short = []
                for a, b, x in zip(starts[odd].tolist(), ends[odd].tolist(), h[odd].tolist()):
                    w = body[a:b].tobytes().decode()
                    w = w[: x % len(w)] + w[x % len(w) + 1 :]
                    if len(w) >= least:
                        short.append(w)
                words.append(pa.array(short, pa.large_string()))
                counts = pc.value_counts(pa.chunked_array(words).combine_chunks())
                yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], names=["word", "n"])

    return run


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """The words of whole texts: word, n (occurrences), for those of at least so many letters and occurrences.

    A run of letters A-Z, a-z, U+00C0 to U+00FF, A-Z lower-cased, is a word; where the CRC-32 h of "<id>:<run>"
    divides by 199, it loses the letter at h modulo its length. Null text has no words; a null id is the empty string there."""
    one = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text_col}`").alias("x"))
    found = one.mapInArrow(_runs(least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted words. A step's letter leads to (state, words that branch off before)."""

    def __init__(self, words):
        self.steps, self.final, self.below = [], [], []
        known, path, last = {}, [(False, [])], ""
        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            self._close(known, path, last, same)
            path.extend((False, []) for _ in word[same:])
            path[-1] = (True, path[-1][1])
            last = word
        self._close(known, path, last, 0)
        self.start = self._state(known, *path[0])

    def _close(self, known, path, last, depth):
        while len(path) > depth + 1:
            state = self._state(known, *path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    def _state(self, known, final, steps):
        """Equal ends are one state."""
        key = (final, *steps)
        if key not in known:
            known[key] = len(self.steps)
            n, told = int(final), {}
            for letter, state in steps:
                told[letter] = (state, n)
                n += self.below[state]
            self.steps.append(told)
            self.final.append(final)
            self.below.append(n)
        return known[key]

    def walk(self, state, number, text, at=0):
        """(state, number) after text[at:], or None."""
        steps = self.steps
        for k in range(at, len(text)):
            found = steps[state].get(text[k])
            if found is None:
                return None
            state, number = found[0], number + found[1]
        return state, number

    def with_one_error(self, half, rest):
        """Numbers of the words half + x, x one letter inserted in, deleted from or replaced in rest."""
        place = self.walk(self.start, 0, half)
        found = set()
        if place is None:
            return found
        state, number = place

        def end(at_state, at_number, k):
            done = self.walk(at_state, at_number, rest, k)
            if done is not None and self.final[done[0]]:
                found.add(done[1])

        for k in range(len(rest) + 1):
            here = rest[k] if k < len(rest) else None
            for letter, (child, before) in self.steps[state].items():
                if letter != here:  # the same letter is inserted behind it
                    end(child, number + before, k)
                    if here is not None:
                        end(child, number + before, k + 1)
            if here is None:
                break
            if k + 1 == len(rest) or rest[k + 1] != here:  # of equal letters the last is deleted
                end(state, number, k + 1)
            place = self.steps[state].get(here)
            if place is None:
                break
            state, number = place[0], number + place[1]
        return found


def _answer(key, table):
    """Arrow group mapper: a group's words and questions to links (word, near, near_n)."""
    back = -1 if key[0].as_py() else 1
    words, counts, asks = table.column("word").to_pylist(), table.column("n").to_pylist(), table.column("asks").to_pylist()
    entries = sorted({(w[::back], n) for w, n, ask in zip(words, counts, asks) if not ask})
    own = [w for w, _ in entries]
    automaton = Automaton(own)
    left, near, near_n = [], [], []
    for w in (w for w, ask in zip(words, asks) if ask):
        half = len(w) // 2
        exact = half if back > 0 else len(w) - half
        asked = w[::back]
        for number in automaton.with_one_error(asked[:exact], asked[exact:]):
            other = own[number][::back]
            if back < 0 and other.startswith(w[:half]):
                continue  # found forward
            left.append(w)
            near.append(other)
            near_n.append(entries[number][1])
    return pa.table({"word": pa.array(left, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(near_n, pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """words: word (each once, of at least LEAST_LENGTH letters), n. All links (word, near, near_n), in both directions."""
    length = F.length("word")
    sides = []
    for back in (False, True):
        # a word of so many letters is met by those of one letter less or more: their halves, cut from it
        cuts = F.array_distinct(
            F.transform(F.filter(F.array(length - 1, length, length + 1), lambda m: m >= LEAST_LENGTH), lambda m: m - F.floor(m / 2).cast("int") if back else F.floor(m / 2).cast("int"))
        )
        own = length - F.floor(length / 2).cast("int") if back else F.floor(length / 2).cast("int")
        each = words.select("word", "n", own.alias("own"), F.explode(cuts).alias("cut"))
        half = F.expr("right(word, cut)") if back else F.expr("left(word, cut)")
        sides.append(each.select(F.lit(back).alias("back"), half.alias("half"), "word", "n", (F.col("own") == F.col("cut")).alias("mine")))
    rows = durable(sides[0].unionByName(sides[1]))
    buckets = 1 + rows.count() // BUCKET
    hot = rows.groupBy("back", "half").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET)
    hot = hot.select("back", "half", F.ceil(F.col("c") / BUCKET).cast("int").alias("blocks"))
    told = rows.join(hot, ["back", "half"], "left").withColumn("ways", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("word"), F.col("ways")).cast("int")
    bucket = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("half"), F.lit(buckets))).otherwise(F.lit(-1))
    named = told.select("back", bucket.alias("bucket"), F.when(F.col("blocks").isNotNull(), F.col("half")).alias("hot"), "word", "n", "mine", block.alias("block"), F.sequence(F.lit(0), F.col("ways") - 1).alias("all"))
    entries = named.select("back", "bucket", "hot", "word", "n", F.lit(False).alias("asks"), F.explode("all").alias("chunk"), "block")
    asked = named.where("mine").select("back", "bucket", "hot", "word", "n", F.lit(True).alias("asks"), F.col("block").alias("chunk"), F.explode("all").alias("block"))
    groups = entries.unionByName(asked).groupBy("back", "bucket", "hot", "chunk", "block")
    out = durable(groups.applyInArrow(_answer, "word string, near string, near_n long"))
    release(rows)
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word of corpus_words: word, form, root, n, n_near, form_n.

    form is the near word of largest n, of equal ones the smallest by code points, if that n is at least 5 times the word's, else
    null; root is where forms lead to from the word, the word itself if it has none; n_near counts near words. Defined
    cases: null texts, texts without words and an empty table have no words; repeated rows and ids count each time; a text or a run of any length is
    read whole, in one task's memory at about 40 times its bytes; other columns are ignored."""
    words = durable(corpus_words(docs, id_col, text_col))
    links = near_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")
    most = links.groupBy("word").agg(F.count("*").alias("n_near"), best).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))
    fits = F.col("near_n") >= FACTOR * F.col("n")
    told = words.join(most, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")
    )
    told = durable(told)
    release(links, words)
    steps = durable(told.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # counts grow along forms, so they end; each round doubles the steps
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = durable(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        release(steps)
        steps = longer
        if not steps.where("moved").limit(1).count():
            break
    return told.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
