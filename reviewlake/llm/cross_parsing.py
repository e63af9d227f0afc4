"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is turned into a suffix automaton. A text
is parsed against each language: the longest prefix that occurs in the sample is one
phrase, then the rest is parsed on. With ``c`` phrases over a sample of ``n`` characters
the text costs ``c * log2(n)`` bits; the language with the fewest bits per character wins.

Texts are lower-cased, letters stay, and a run of other signs is one space. They are cut
into segments of ``SEGMENT`` signs that are parsed side by side in numpy, one automaton
step for all segments at a time; a phrase ends where its segment ends, for every language
alike, and every sign of every text is parsed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reviewlake.llm.text_arrays import code_points, groups
from reviewlake.session import persist_reliably

#: Bounds of the sample: documents per language and letters or spaces per language.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 30_000
#: All automata of one run together hold about this many signs of sample.
ALL_SAMPLE_CHARS = 600_000
#: A document gives this many pieces of its share, from places all over its text.
PIECES = 8
#: More different values of ``lang`` are an error: they are not languages.
MAX_LANGUAGES = 64
SEGMENT = 512
GROUP = 1 << 20
UNDECIDED = "und"
#: A text is in a language if it costs up to ``MARGIN`` times the bits per sign of the labelled
#: texts beside the sample, and some phrases more, which matter to short texts only.
MARGIN = 1.5
SPARE_PHRASES = 2
LEAST_BESIDE = 20
#: The bound where too few labelled texts are beside the sample. Text of a learnt language costs 2 to 6;
#: where every sign breaks the parse it costs log2 of the sample.
MAX_BITS = 10.0
SALT = 20
#: Automata with a larger table of states by signs are hashed.
DENSE_CELLS = 1 << 22


@dataclass(frozen=True)
class Profile:
    """A language, its sample, and the bits per sign up to which a text may be in it."""

    language: str
    sample: str
    max_bits: float = MAX_BITS


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For every code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for point in range(0x110000):
        sign = chr(point)
        if sign.isalpha():
            low = sign.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def folded_signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters in lower case with single spaces between, and their offsets.

    Each text begins with a space.
    """
    points, starts = code_points([" " + t for t in texts], " ")
    signs = _folded()[points]
    blank = signs == 32
    kept = ~(blank & np.concatenate(([False], blank[:-1])))
    kept[starts[:-1]] = True
    places = np.concatenate(([0], np.cumsum(kept)))
    return signs[kept], places[starts]


def fold(text: str) -> str:
    return folded_signs([text])[0].astype("<u4").tobytes().decode("utf-32-le")


def suffix_automaton(sample: str) -> list[dict[str, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for sign in sample:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and sign not in moves[at]:
            moves[at][sign] = new
            at = link[at]
        if at >= 0:
            target = moves[at][sign]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                clone = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = link[new] = clone
                while at >= 0 and moves[at].get(sign) == target:
                    moves[at][sign] = clone
                    at = link[at]
        last = new
    return moves


class Parser:
    """One language's automaton: the next state by state and sign code, 0 where there is none.

    Small alphabets have a table of states by signs. A large one, as of Chinese, has its moves in
    a hash table of four cells a move, so that memory follows the sample and not the alphabet.
    """

    def __init__(self, sample: str) -> None:
        alphabet = sorted(set(sample))
        self.width = len(alphabet) + 1
        self.codes = np.zeros(0x110000, dtype=np.uint8 if self.width < 256 else np.uint16)
        for i, sign in enumerate(alphabet):
            self.codes[ord(sign)] = i + 1
        self.bits = math.log2(max(len(sample), 2))
        moves = suffix_automaton(sample)
        keys = np.array([s * self.width + int(self.codes[ord(c)]) for s, out in enumerate(moves) for c in out], dtype=np.int64)
        targets = np.array([t for out in moves for t in out.values()], dtype=np.int32)
        self.dense = len(moves) * self.width <= DENSE_CELLS
        if self.dense:
            self.table = np.zeros(len(moves) * self.width, dtype=np.int32)
            self.table[keys] = targets * self.width
        else:
            self._hash(keys, targets)

    def _hash(self, keys: np.ndarray, targets: np.ndarray) -> None:
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.table = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        cell, left = self._cell(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[cell[left]] < 0]
            self.keys[cell[free]] = keys[free]
            placed = free[self.keys[cell[free]] == keys[free]]
            self.table[cell[placed]] = targets[placed] * self.width
            left = np.setdiff1d(left, placed, assume_unique=True)
            cell[left] = (cell[left] + 1) & self.mask

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def after(self, places: np.ndarray) -> np.ndarray:
        """The moves at ``state * width + code``, as the next state's first place."""
        if self.dense:
            return self.table[places]
        places = places.astype(np.int64)
        cell = self._cell(places)
        out = np.zeros(len(places), dtype=np.int32)
        left = np.arange(len(places))
        while len(left):
            found = self.keys[cell[left]]
            hit = left[found == places[left]]
            out[hit] = self.table[cell[hit]]
            left = left[(found != places[left]) & (found >= 0)]
            cell[left] = (cell[left] + 1) & self.mask
        return out

    def phrases(self, segments: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of phrases of each segment; segments are columns, longest first.

        An unknown sign is a phrase of its own.
        """
        coded = self.codes[segments]
        count = np.zeros(segments.shape[1], dtype=np.int64)
        at = np.zeros(segments.shape[1], dtype=np.int32)
        active = np.searchsorted(-sizes, -np.arange(len(coded)), side="left")
        for step, n in enumerate(active.tolist()):
            signs = coded[step, :n]
            to = self.after(at[:n] + signs)
            ended = to == 0
            # A phrase begins at the start state, or where the one before cannot go on.
            count[:n] += ended | (at[:n] == 0)
            restart = np.flatnonzero(ended)
            to[restart] = self.after(signs[restart])
            at[:n] = to
        return count


@lru_cache(maxsize=4)
def parsers(profiles: tuple[Profile, ...]) -> tuple[Parser, ...]:
    """Built once for each Python worker."""
    return tuple(Parser(p.sample) for p in profiles)


def phrase_counts(texts: list[str], profiles: tuple[Profile, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text (rows) in each language (columns), NaN without letters, and the texts' signs."""
    signs, offsets = folded_signs(texts)
    lengths = np.diff(offsets)
    # The texts' own signs follow the leading space.
    pieces = -(-lengths // SEGMENT)
    first = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(texts)), pieces)
    begin = np.repeat(offsets[:-1] - first * SEGMENT, pieces) + np.arange(len(owner)) * SEGMENT
    sizes = np.minimum(np.repeat(offsets[1:], pieces) - begin, SEGMENT)
    order = np.argsort(-sizes, kind="stable")
    sizes, owner = sizes[order], owner[order]
    padded = np.concatenate((signs, np.full(SEGMENT, 32, dtype=signs.dtype)))
    matrix = padded[begin[order][None, :] + np.arange(int(sizes[0]))[:, None]]
    letters = np.add.reduceat(signs != 32, offsets[:-1])
    out = np.empty((len(texts), len(profiles)))
    for k, parser in enumerate(parsers(profiles)):
        out[:, k] = np.bincount(owner, weights=parser.phrases(matrix, sizes), minlength=len(texts))
    out[letters == 0] = np.nan
    return out, lengths


def costs_of(phrases: np.ndarray, lengths: np.ndarray, profiles: tuple[Profile, ...], spare: int = 0) -> np.ndarray:
    """Bits per sign from phrases, of which ``spare`` are not counted."""
    bits = np.array([p.bits for p in parsers(profiles)])
    return np.maximum(phrases - spare, 0) * bits / lengths[:, None]


def costs(texts: list[str], profiles: tuple[Profile, ...], spare: int = 0) -> np.ndarray:
    """Bits per sign of each text (rows) in each language (columns); NaN without letters."""
    return costs_of(*phrase_counts(texts, profiles), profiles, spare)


def _pieces(text: str, size: int, doc_id: int) -> str:
    """``PIECES`` stretches of ``size`` signs of a folded text, from all over it, in an order of chance."""
    signs = fold(text)
    if len(signs) <= PIECES * size:
        return signs
    part = len(signs) / PIECES
    chance = np.random.default_rng([SALT, doc_id & (1 << 63) - 1])
    begins = (np.arange(PIECES) * part + chance.random(PIECES) * (part - size)).astype(int)
    return "".join(signs[b : b + size] for b in chance.permutation(begins))


def fit_profiles(
    labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS
) -> tuple[Profile, ...]:
    """A sample of each language's labelled texts (doc_id, text, lang), and the bound of its bits.

    Rows with a NULL text, id or language or without a letter are left out. Per language the
    ``sample_docs`` documents of smallest id hash give up to ``sample_chars`` signs in equal parts, from
    places all over their texts, less if there are so many languages that their automata would exceed
    ``ALL_SAMPLE_CHARS``. The next ``sample_docs`` documents set the bound; of fewer than twice as many
    three quarters are the sample, and fewer than ``LEAST_BESIDE`` beside it set no bound. More than ``MAX_LANGUAGES``
    values of ``lang`` are an error. So the driver receives at most ``MAX_LANGUAGES * sample_docs *
    PIECES * 2 * sample_chars / sample_docs`` signs. Ranking works on narrow rows and is cut in each task
    before the shuffle.
    """
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    languages = usable.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    narrow = usable.select("doc_id", "lang", F.xxhash64(F.lit(SALT), "doc_id").alias("_h"))
    ranked = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = persist_reliably(
        narrow.withColumn("_r", F.row_number().over(ranked))
        .filter(F.col("_r") <= 2 * sample_docs)
        .groupBy("doc_id", "lang")
        .agg(F.min("_r").alias("_r"))
        .withColumn("_n", F.count("*").over(Window.partitionBy("lang")))
        .select("doc_id", "lang", (F.col("_r") <= F.least(F.lit(sample_docs), F.ceil(0.75 * F.col("_n")))).alias("_sampled"))
    )
    # At most 2 * sample_docs rows a language.
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    size = 2 * max(1, sample_chars // sample_docs)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_pieces(t, size, d) for d, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["doc_id", "lang", "signs"])

    sampled = texts.filter("_sampled").select("doc_id", "lang", "text")
    rows = sampled.mapInArrow(pieces, "doc_id long, lang string, signs string").dropDuplicates(["doc_id", "lang"]).collect()
    by_language: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        by_language.setdefault(row["lang"], []).append(row["signs"])
    profiles = []
    for language in sorted(by_language):
        limit = min(sample_chars, max(500, ALL_SAMPLE_CHARS // len(by_language)))
        own = by_language[language]
        share = max(1, limit // len(own))
        sample = "".join(t[:share] for t in own)
        if len(sample) < limit:  # short texts leave room to the longer ones
            sample += "".join(t[share:] for t in own)[: limit - len(sample)]
        profiles.append(Profile(language, sample))
    return _bounded(tuple(profiles), texts.filter("NOT _sampled"))


def _bounded(profiles: tuple[Profile, ...], beside: DataFrame) -> tuple[Profile, ...]:
    """The profiles with the bounds that labelled texts beside the sample set."""
    if not profiles:
        return profiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {p.language: k for k, p in enumerate(profiles)}
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            own = [np.zeros(0)]
            for lo, hi in groups(texts, GROUP):
                cost = costs(texts[lo:hi], profiles, spare=SPARE_PHRASES)
                own.append(cost[np.arange(hi - lo), [number.get(c, 0) for c in langs[lo:hi]]])
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(own))], names=["lang", "cost"])

    worst = beside.select("lang", "text").mapInArrow(run, "lang string, cost double").groupBy("lang").agg(F.max("cost"), F.count("*")).collect()
    bounds = {r[0]: MARGIN * max(r[1], 1.0) for r in worst if r[2] >= LEAST_BESIDE and not math.isnan(r[1])}
    return tuple(Profile(p.language, p.sample, min(MAX_BITS, bounds.get(p.language, MAX_BITS))) for p in profiles)


def predict(docs: DataFrame, profiles: tuple[Profile, ...]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text.

    ``lang_pred`` is the language of fewest bits, ties by name, or ``und`` for a text that
    is NULL or has no letter, or if there are no profiles. ``score`` is the runner-up's
    share of both costs, scaled to 0 (a tie) to 1; with one language it is 1, and 0 for
    ``und``. Other columns are ignored, repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([p.language for p in profiles] + [UNDECIDED], dtype=object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            best, score = np.full(len(texts), len(profiles)), np.zeros(len(texts))
            for lo, hi in groups(texts, GROUP) if profiles else ():
                cost = costs(texts[lo:hi], profiles)
                known = np.flatnonzero(~np.isnan(cost[:, 0]))
                ordered = np.sort(cost[known], axis=1)
                best[lo + known] = np.argmin(cost[known], axis=1)
                second = ordered[:, 1] if len(profiles) > 1 else np.full(len(known), np.inf)
                score[lo + known] = 1 - ordered[:, 0] / second
            yield pa.record_batch(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known_language(docs: DataFrame, profiles: tuple[Profile, ...], max_bits: float | None = None) -> DataFrame:
    """``docs`` without the rows whose language is undecided or none of the learnt ones.

    A text goes if it is NULL, has no letter, costs more than ``MAX_BITS`` per sign in its best
    language, as text in another script does, or costs more in each language than that language's
    bound, ``SPARE_PHRASES`` phrases left aside, as another language of the same script does unless
    it is a few words long. With ``max_bits`` only the first bound counts, and is that one. A NULL ``lang`` is filled
    with the predicted language; all other columns and values stay as they are. If there are no
    profiles nothing can be rejected, and all rows stay.
    """
    if not profiles:
        return docs
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")
    bounds = np.array([p.max_bits if max_bits is None else np.inf for p in profiles])
    most = MAX_BITS if max_bits is None else max_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            best, kept = np.full(len(texts), -1), np.zeros(len(texts), dtype=bool)
            for lo, hi in groups(texts, GROUP):
                phrases, lengths = phrase_counts(texts[lo:hi], profiles)
                whole, spared = (costs_of(phrases, lengths, profiles, spare) for spare in (0, SPARE_PHRASES))
                known = np.flatnonzero(~np.isnan(whole[:, 0]))
                best[lo + known] = np.argmin(whole[known], axis=1)
                kept[lo + known] = (whole[known].min(axis=1) <= most) & (spared[known] <= bounds).any(axis=1)
            given = batch.column(lang_at).to_pylist()
            filled = [profiles[k].language if g is None and k >= 0 else g for g, k in zip(given, best.tolist(), strict=True)]
            columns = list(batch.columns)
            columns[lang_at] = pa.array(filled, batch.schema.field(lang_at).type)
            yield pa.record_batch(columns, schema=batch.schema).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
