"""Per-document text quality statistics and a verdict: running speech or something else.

Method: a text of more than ``CHUNK`` bytes is cut into chunks at fixed byte positions,
wherever they fall, and the chunks are spread over tasks. A chunk gives the partial
counts of the lines that lie in it whole and, as boundary state, the bytes of the line
it begins within and of the line it ends within. Two neighbouring partials merge by
adding counts and counting the line that their boundary states make up together; that
is associative, so the partials of a document are merged as a tree: runs of ``FAN``
chunks in one task each, then the runs of a document. The counts of a line depend on
that line only, so merged partials equal the counts of the whole text for every chunk
size. Shorter texts are one partial each. A line of more than ``LINE`` bytes is counted
as several, cut behind every ``LINE`` bytes at the next blank, so the boundary
state is bounded. Ratios and rules are derived from the root. All counting is done on
whole batches of bytes by array operations, not line by line.

A line is set aside if it is blank, a cue number, a time line, a header, an advert
or only a sound description; markup and descriptions inside a line are blanked. Of
the remaining lines each is speech or not: speech ends like a sentence, or holds
common words, or Japanese syllables, or letters read in a wrong encoding, or is sung.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import pieces

CHUNK = 1 << 14
#: Chunks of a run.
FAN = 64
LINE = 1 << 12
#: Bytes of short texts worked on at once; the arrays then stay in the processor's cache.
PIECE = 1 << 18
# Common words of the corpus' languages, at most eight bytes each.
COMMON = {
    "en": "the you i a and it that to of is we me he she they was in not what this for if so us are my have no them your do be but with at",
    "es": "de que no la el un una es y en lo por los me su se mi con está para qué yo él ella pero fue era ese esta",
    "de": "ich das ist nicht wir du und es die der den zu ein einen was sie er mit auf hat war uns wie nur wo dass im am",
    "fr": "je ne pas le la de un une est que il elle on et ce nous vous les des du au dans pour ma ton ce c'est où qui",
    "ru": "не я что он она мы на и это как был ты был нас с у мне мой твой наш её по за от до",
}
# Links, and the credit formulas of subtitle files in general.
ADVERTS = (b"www.", b"http:", b"https:", b"subtitles by", b"subtitled by", b"captions by", b"captioned by", b"synced by", b"corrected by", b"translated by", b"download")
HEADERS = (b"webvtt", b"note", b"style", b"region", b"x-timestamp-map")
_BLANK, _LETTER, _DIGIT, _MARK, _SYMBOL, _NOTE = range(6)
#: Counts of a line.
FIELDS = ["bytes", "chars", "letters", "letter_chars", "digits", "marks", "symbols", "notes", "digit_runs", "words", "common", "kana", "wrong", "arrow", "advert"]
FIRST, LAST, STAR = range(len(FIELDS), len(FIELDS) + 3)  # first visible byte, whether it ends like a sentence, stars around
WIDTH = len(FIELDS) + 3
#: Document sums.
SUMS = ["lines", "n_chars", "n_words", "word_chars", "visible", "symbols", "ended", "common", "speech", "other"]


def _table() -> np.ndarray:
    c = np.full(256, _LETTER, np.uint8)
    c[:128] = _MARK
    c[:33] = _BLANK
    c[127] = _BLANK
    c[48:58] = _DIGIT
    c[65:91] = c[97:123] = _LETTER
    return c


_CLASS = _table()


def _pack(word: bytes) -> int:
    return int.from_bytes(word[:8].ljust(8, b"\0"), "little")


def _common_words() -> np.ndarray:
    packed = set()
    for words in COMMON.values():
        for w in words.split():
            for form in (w, w.capitalize(), w.upper()):
                raw = form.encode()
                raw = bytes(b | 32 if 65 <= b <= 90 else b for b in raw)
                if len(raw) <= 8 and b"'" not in raw:
                    packed.add(_pack(raw))
    return np.array(sorted(packed), np.uint64)


_COMMON = _common_words()
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _between(b: np.ndarray, opening: int, closing: int, line: np.ndarray, most: int, inner=None) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of spans from an opening to the next closing byte in the same line, at most ``most`` bytes long."""
    lo, hi = np.flatnonzero(b == opening), np.flatnonzero(b == closing)
    if not len(lo) or not len(hi):
        return lo[:0], lo[:0]
    if inner is not None:
        lo = lo[inner(b, lo)]
    at = np.searchsorted(hi, lo)
    lo, at = lo[at < len(hi)], at[at < len(hi)]
    end = hi[at]
    ok = (line[end] == line[lo]) & (end - lo <= most)
    return lo[ok], end[ok] + 1


def _is_tag(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    following = b[np.minimum(at + 1, len(b) - 1)]
    return (following == 47) | ((following | 32) >= 97) & ((following | 32) <= 122)


def line_starts(b: np.ndarray, limits: np.ndarray, line: int = LINE) -> np.ndarray:
    """Starts of the lines of texts laid end to end; limits: starts of the texts. CR, LF and CRLF end a line; a line of
    more than ``line`` bytes goes on as a new one behind every ``line`` bytes, at the next blank if one is near, else at the
    next start of a character."""
    n = len(b)
    mark = np.zeros(n, bool)
    mark[1:] = ((b[:-1] == 10) | (b[:-1] == 13)) & ~((b[:-1] == 13) & (b[1:] == 10))
    mark[limits[limits < n]] = True
    start = np.flatnonzero(mark)
    size = np.diff(np.append(start, n))
    long = np.flatnonzero(size > line)
    if len(long):
        at = np.concatenate([np.arange(s + line, s + k, line) for s, k in zip(start[long], size[long], strict=True)])
        stop = np.repeat(start[long] + size[long], (size[long] - 1) // line)
        blank = np.zeros(len(at), bool)
        for d in range(64):  # behind the next blank, if one is near
            new = ~blank & (at + d < stop) & (b[np.minimum(at + d, n) - 1] == 32)
            at[new] += d
            blank |= new
        for _ in range(4):
            at += (at < stop) & ((b[np.minimum(at, n - 1)] & 0xC0) == 0x80)
        mark[at[at < stop]] = True
        start = np.flatnonzero(mark)
    return start


def line_counts(b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Counts of every line, each as if it stood alone; start: starts of the lines, the first at 0."""
    n = len(b)
    end = (b == 10) | (b == 13)
    mark = np.zeros(n, bool)
    mark[start] = True
    line = np.cumsum(mark, dtype=np.int32) - 1
    last = np.append(start[1:], n) - 1
    final = np.zeros(n, bool)
    final[last] = True
    c = _CLASS[b]
    high = b >= 0x80
    if high.any():
        two = np.flatnonzero(b == 0xC2)
        c[two] = _SYMBOL
        c[np.minimum(two + 1, n - 1)] = _SYMBOL
        for lead, then, cls in ((0xC3, (0x97, 0xB7), _SYMBOL),):
            at = np.flatnonzero(b[:-1] == lead)
            at = at[np.isin(b[at + 1], then)]
            c[at] = c[at + 1] = cls
        for lead in (0xE2, 0xE3, 0xEF):
            at = np.flatnonzero(b[:-2] == lead)
            x, y = b[at + 1], b[at + 2]
            if lead == 0xE2:
                cls = np.where((x == 0x99) & ((y == 0xAA) | (y == 0xAB)), _NOTE, np.where((x == 0x80) & (y >= 0x8B) & (y <= 0x8F), _BLANK, _SYMBOL))
            elif lead == 0xE3:
                cls = np.where(x != 0x80, _LETTER, np.where(y == 0x80, _BLANK, _MARK))
            else:
                cls = np.where((x == 0xBB) & (y == 0xBF), _BLANK, np.where((x == 0xBC) & (y <= 0xA0), _MARK, _LETTER))
            for k in range(3):
                c[at + k] = cls
    # Sound descriptions and markup are blanked; a line in stars is looked at below.
    change = np.zeros(n + 1, np.int32)
    for opening, closing, most, inner in ((60, 62, 80, _is_tag), (91, 93, 200, None), (40, 41, 200, None), (123, 125, 200, None)):
        lo, hi = _between(b, opening, closing, line, most, inner)
        np.add.at(change, lo, 1)
        np.add.at(change, hi, -1)
    blanked = np.cumsum(change[:-1]) > 0
    arrow_at = np.flatnonzero((b[:-2] == 45) & (b[1:-1] == 45) & (b[2:] == 62) & (line[:-2] == line[2:])) if n > 2 else np.empty(0, int)
    c[blanked] = _BLANK
    letter, digit = c == _LETTER, c == _DIGIT
    whole = (b & 0xC0) != 0x80
    sums = lambda m: np.add.reduceat(m, start, dtype=np.int32)
    out = np.zeros((len(start), WIDTH), np.int32)
    out[:, 0] = np.diff(np.append(start, n))
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    opens[start] = letter[start]
    digits = digit.copy()
    digits[1:] &= ~digit[:-1]
    digits[start] = digit[start]
    for k, m in ((1, whole & ~end), (2, letter), (3, letter & whole), (4, digit), (5, c == _MARK), (6, (c == _SYMBOL) & whole), (7, (c == _NOTE) & whole), (8, digits), (9, opens)):
        out[:, k] = sums(m)
    # common words: the first eight bytes of each word, ASCII in small letters
    w = np.flatnonzero(opens)
    if len(w):
        closes = letter.copy()
        closes[:-1] &= ~letter[1:]
        closes[last] = letter[last]
        z = np.flatnonzero(closes)
        size = z - w + 1
        # letters beside digits are no word of a language
        alone = ~(digit[np.maximum(w - 1, 0)] & ~mark[w]) & ~(digit[np.minimum(z + 1, n - 1)] & ~final[z])
        small = np.concatenate([np.where((b >= 65) & (b <= 90), b | 32, b), np.zeros(8, np.uint8)])
        eight = np.ndarray(n + 1, "<u8", small, strides=(1,))
        short = np.flatnonzero((size <= 8) & alone)
        word = eight[w[short]] & _LOW[size[short]]
        hit = w[short][_COMMON[np.minimum(np.searchsorted(_COMMON, word), len(_COMMON) - 1)] == word]
        out[:, 10] = np.bincount(line[hit], minlength=len(start))
    if high.any():
        kana = np.flatnonzero((b[:-1] == 0xE3) & (b[1:] >= 0x81) & (b[1:] <= 0x83))
        out[:, 11] = np.bincount(line[kana[letter[kana]]], minlength=len(start))
        c3 = np.flatnonzero(b[:-2] == 0xC3)
        x, y = b[c3 + 1], b[c3 + 2]
        odd = (line[c3] == line[c3 + 2]) & (((x >= 0x82) & (x <= 0x83)) | ((x >= 0x90) & (x <= 0x91)) | ((x >= 0xA2) & (x <= 0xAF))) & ((y == 0xC2) | ((y >= 0xC5) & (y <= 0xC6)) | (y == 0xCB) | (y == 0xE2))
        out[:, 12] = np.bincount(line[c3[odd]], minlength=len(start))
    out[:, 13] = np.bincount(line[arrow_at], minlength=len(start)) if len(arrow_at) else 0
    low = b.tobytes().lower()
    for phrase in ADVERTS:
        at = low.find(phrase)
        while at >= 0:
            out[line[at], 14] += line[at] == line[at + len(phrase) - 1]
            at = low.find(phrase, at + len(phrase))
    seen = np.flatnonzero((c != _BLANK) & (c != _NOTE))
    if len(seen):
        rows, first = np.unique(line[seen], return_index=True)
        behind = np.append(first[1:], len(seen)) - 1
        out[rows, FIRST] = b[seen[first]]
        out[rows, LAST] = _terminal(b, c, seen, first, behind)
        lone = (out[rows, FIRST] == 42) & (b[seen[behind]] == 42) & (out[rows, 2] > 0)
        out[rows[lone], STAR] = 1
    if any(h in low for h in HEADERS):
        maybe = np.flatnonzero(np.isin(out[:, FIRST] | 32, [h[0] for h in HEADERS]) & (out[:, 9] <= 2) & (out[:, LAST] == 0))
        for k in maybe.tolist():
            if low[start[k] : min(start[k] + 24, last[k] + 1)].lstrip(b"\xef\xbb\xbf \t").startswith(HEADERS):
                out[k, 13] += 1
    return out


def _terminal(b, c, seen, first, final) -> np.ndarray:
    """1 where a line ends like a sentence: . ! ? or their wide and Japanese forms, quotes and brackets behind it aside."""
    good = np.zeros(len(first), np.int32)
    at = final.copy()
    for _ in range(3):
        p = seen[at]
        x, y, z = b[p], b[np.maximum(p - 1, 0)], b[np.maximum(p - 2, 0)]
        ends = np.isin(x, (46, 33, 63))
        ends |= (z == 0xE2) & (y == 0x80) & (x == 0xA6)
        ends |= (z == 0xE3) & (y == 0x80) & (x == 0x82)
        ends |= (z == 0xEF) & (y == 0xBC) & ((x == 0x81) | (x == 0x9F) | (x == 0x8E))
        good |= ends
        wide = (c[p] == _SYMBOL) & (z == 0xE2) & (y == 0x80) & (x >= 0x98) & (x <= 0x9F)
        angle = (y == 0xC2) & (x == 0xBB)
        wide_quote = (z == 0xE3) & (y == 0x80) & ((x == 0x8D) | (x == 0x8F))
        step = np.where(np.isin(x, (34, 39, 41, 93)), 1, np.where(angle, 2, np.where(wide | wide_quote, 3, 0)))
        at = np.maximum(at - step, first)
        if not step.any():
            break
    return good


def judged(counts: np.ndarray) -> np.ndarray:
    """0: set aside, 1: speech, 2: something else, for every line."""
    f = {name: counts[:, k] for k, name in enumerate(FIELDS)}
    visible = f["letters"] + f["digits"] + f["marks"] + 3 * f["symbols"]
    number = (f["digit_runs"] == 1) & (f["digits"] == visible)
    aside = ((visible == 0) & (f["notes"] == 0)) | number | (f["arrow"] > 0) | (f["advert"] > 0) | (counts[:, STAR] > 0)
    only_marks = (f["letters"] == 0) & (f["digits"] == 0) & (visible <= 2) & (f["notes"] == 0)
    sentence = (counts[:, LAST] > 0) & (f["letters"] >= 2) & (2 * f["letters"] >= visible)
    sung = (f["notes"] >= 2) & (f["words"] >= 2) & (2 * f["letters"] >= visible)
    speech = sentence | sung | (f["common"] >= 2) | (f["kana"] >= 2) | (f["wrong"] >= 2)
    return np.where(aside | only_marks, 0, np.where(speech, 1, 2))


def _doc_sums(counts: np.ndarray) -> np.ndarray:
    """The part of each line in the document sums."""
    verdict = judged(counts)
    f = {name: counts[:, k] for k, name in enumerate(FIELDS)}
    kept = verdict > 0
    visible = f["letters"] + f["digits"] + f["marks"] + f["symbols"]
    cols = [np.ones(len(counts), int), f["chars"], f["words"] * kept, f["letter_chars"] * kept, visible * kept, (f["marks"] + f["symbols"]) * kept, (counts[:, LAST] > 0) & kept, f["common"] * kept, verdict == 1, verdict == 2]
    return np.stack([np.asarray(x, np.int64) for x in cols], axis=1)


def _sums(b: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _doc_sums(line_counts(b, start)).sum(axis=0) if len(b) else np.zeros(len(SUMS), np.int64)


@dataclass
class Partial:
    """Sums of the lines that lie whole in a stretch of text, the bytes before its first line start and those from its
    last line start on; without a line start all bytes are ``head`` and there is no ``tail``."""

    sums: np.ndarray
    head: bytes
    tail: bytes | None

    @staticmethod
    def of(b: np.ndarray, opens: bool, cuts: np.ndarray) -> Partial:
        """opens: whether a line starts at the first byte; cuts: further starts, inside lines that are too long."""
        start = line_starts(b, np.zeros(1, np.int64), max(len(b), 1))
        start = np.union1d(start if opens else start[1:], cuts).astype(np.int64)
        if not len(start):
            return Partial(np.zeros(len(SUMS), np.int64), b.tobytes(), None)
        inner = b[start[0] : start[-1]]
        return Partial(_sums(inner, start[:-1] - start[0]), b[: start[0]].tobytes(), b[start[-1] :].tobytes())


def merge(parts: list[Partial]) -> Partial:
    """Neighbouring partials in order as one. The lines that two or more of them make up are counted at once."""
    made: list[bytes] = []
    head, tail = parts[0].head, parts[0].tail
    for p in parts[1:]:
        if p.tail is None:
            head, tail = (head + p.head, None) if tail is None else (head, tail + p.head)
        else:
            if tail is None:
                head += p.head
            else:
                made.append(tail + p.head)
            tail = p.tail
    total = np.sum([p.sums for p in parts], axis=0)
    if made:
        size = np.cumsum([len(m) for m in made])
        total = total + _sums(np.frombuffer(b"".join(made), np.uint8), np.concatenate([[0], size[:-1]]))
    return Partial(total, head, tail)


def finish(root: Partial) -> np.ndarray:
    """Sums of a whole document: what is left open stands for its last line."""
    rest = np.frombuffer(root.head + (root.tail or b""), np.uint8)
    return root.sums + _sums(rest, np.zeros(1, np.int64))


def cut(b: np.ndarray, chunk: int = CHUNK, line: int = LINE) -> Iterator[tuple[np.ndarray, bool, np.ndarray]]:
    """Chunks of a text as (bytes, whether a line starts with them, starts inside lines that are too long)."""
    start = line_starts(b, np.zeros(1, np.int64), line)
    own = np.setdiff1d(start, line_starts(b, np.zeros(1, np.int64), max(len(b), 1)), assume_unique=True)
    for at in range(0, len(b), chunk):
        stop = min(at + chunk, len(b))
        k = int(np.searchsorted(start, at))
        yield b[at:stop], k < len(start) and start[k] == at, own[np.searchsorted(own, at) : np.searchsorted(own, stop)] - at


def text_sums(b: np.ndarray, chunk: int = CHUNK, line: int = LINE) -> np.ndarray:
    """Document sums of one text by chunks and a merge tree."""
    parts = [Partial.of(*x) for x in cut(b, chunk, line)]
    while len(parts) > 1:
        parts = [merge(parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return finish(parts[0]) if parts else np.zeros(len(SUMS), np.int64)


def batch_sums(b: np.ndarray, limits: np.ndarray, line: int = LINE) -> np.ndarray:
    """Document sums of many texts laid end to end."""
    out = np.zeros((len(limits) - 1, len(SUMS)), np.int64)
    if len(b):
        start = line_starts(b, limits[:-1], line)
        some = np.flatnonzero(np.diff(limits) > 0)
        out[some] = np.add.reduceat(_doc_sums(line_counts(b, start)), np.searchsorted(start, limits[:-1][some]), axis=0)
    return out


SCHEMA = "doc_id bigint, n_chars bigint, n_lines bigint, n_words bigint, mean_word_length double, symbol_ratio double, end_punctuation_share double, common_word_share double, speech_lines bigint, other_lines bigint, is_speech boolean"


def quality(documents: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: characters (line ends aside) and lines of the whole text; of the remaining lines the
    words, mean word length, share of marks and symbols in visible characters, share of lines that end like a sentence,
    share of common words, speech and other lines; ``is_speech``: at least half of the remaining lines are speech.

    NULL, empty and blank texts, and texts of which nothing remains, have zero counts, NULL ratios and NULL verdict.
    Repeated rows each come out; other columns are ignored. Texts are worked whole, whatever their length."""

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, stop, b, limits in pieces(batch.column(1), PIECE):
                long = np.flatnonzero(np.diff(limits) > chunk)
                short = np.setdiff1d(np.arange(stop - at), long)
                ids = batch.column(0).slice(at, stop - at)
                # Short texts end to end, without the long ones between them.
                keep = np.ones(len(b), bool)
                for k in long:
                    keep[limits[k] : limits[k + 1]] = False
                size = np.diff(limits)[short]
                s = batch_sums(b[keep] if len(long) else b, np.concatenate([[0], np.cumsum(size)]))
                yield _rows(ids.take(pa.array(short)), row + short, np.zeros(len(short), np.int64), s)
                for k in long:
                    parts = list(cut(b[limits[k] : limits[k + 1]], chunk))
                    for lo in range(0, len(parts), FAN):
                        some = parts[lo : lo + FAN]
                        n = len(some)
                        yield _rows(
                            ids.take(pa.array([k] * n)), np.full(n, row + k), np.arange(lo, lo + n), None,
                            raw=[x[0].tobytes() for x in some], opens=[bool(x[1]) for x in some], cuts=[x[2].tolist() for x in some],
                        )
                row += stop - at

    def merged(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, int, Partial, int | None]] = []

            def flush() -> Iterator[pa.RecordBatch]:
                if held:
                    row, part, _, doc = held[0]
                    yield _partial_row(doc, row, part, merge([h[2] for h in held]))
                    held.clear()

            for batch in batches:
                many = np.flatnonzero(~batch.column("sums").is_valid().to_numpy(zero_copy_only=False) | batch.column("head").is_valid().to_numpy(zero_copy_only=False))
                whole = np.setdiff1d(np.arange(batch.num_rows), many)
                if len(whole):
                    yield batch.take(pa.array(whole))
                for r in batch.take(pa.array(many)).to_pylist():
                    if held and (held[0][0] != r["row"] or (not last and held[0][1] // FAN != r["part"] // FAN)):
                        yield from flush()
                    p = Partial(np.array(r["sums"]), r["head"], r["tail"]) if r["raw"] is None else Partial.of(np.frombuffer(r["raw"], np.uint8), r["opens"], np.array(r["cuts"], np.int64))
                    held.append((r["row"], r["part"], p, r["doc_id"]))
            yield from flush()

        return run

    parts = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut_texts, PARTS)
    group = F.floor(F.col("part") / FAN)
    runs = parts.repartition("row", group).sortWithinPartitions("row", "part").mapInArrow(merged(False), PARTS)
    roots = runs.repartition("row").sortWithinPartitions("row", "part").mapInArrow(merged(True), PARTS)

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            all_sums = np.array(batch.column("sums").flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(SUMS)).copy()
            for k in np.flatnonzero(batch.column("head").is_valid().to_numpy(zero_copy_only=False)):
                all_sums[k] = finish(Partial(all_sums[k], batch.column("head")[int(k)].as_py(), batch.column("tail")[int(k)].as_py()))
            s = dict(zip(SUMS, all_sums.T, strict=True))
            with np.errstate(divide="ignore", invalid="ignore"):
                remaining = s["speech"] + s["other"]
                ratios = [s["word_chars"] / s["n_words"], s["symbols"] / s["visible"], s["ended"] / remaining, s["common"] / s["n_words"]]
            verdict = pa.array(s["other"] * 2 <= remaining, mask=remaining == 0)
            doubles = [pa.array(r, pa.float64(), mask=~np.isfinite(r)) for r in ratios]
            cols = [batch.column("doc_id"), pa.array(s["n_chars"]), pa.array(s["lines"]), pa.array(s["n_words"]), *doubles, pa.array(s["speech"]), pa.array(s["other"]), verdict]
            yield pa.RecordBatch.from_arrays(cols, names=[c.strip().split()[0] for c in SCHEMA.split(",")])

    return roots.mapInArrow(derive, SCHEMA)


PARTS = "doc_id bigint, row bigint, part bigint, sums array<bigint>, head binary, tail binary, raw binary, opens boolean, cuts array<int>"
_PARTS = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("sums", pa.list_(pa.int64())), ("head", pa.binary()), ("tail", pa.binary()), ("raw", pa.binary()), ("opens", pa.bool_()), ("cuts", pa.list_(pa.int32()))]
)


def _rows(ids: pa.Array, row: np.ndarray, part: np.ndarray, sums: np.ndarray | None, raw=None, opens=None, cuts=None) -> pa.RecordBatch:
    """Rows of whole texts (sums alone) or of chunks (raw bytes and how they begin)."""
    n = len(row)
    listed = pa.nulls(n, pa.list_(pa.int64())) if sums is None else pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * len(SUMS), len(SUMS), dtype=np.int32)), pa.array(sums.ravel()))
    kinds = [f.type for f in _PARTS]
    more = [pa.nulls(n, k) if v is None else pa.array(v, k) for v, k in zip((raw, opens, cuts), kinds[6:], strict=True)]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(row, pa.int64()), pa.array(part, pa.int64()), listed, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *more], schema=_PARTS)


def _partial_row(doc: int | None, row: int, part: int, p: Partial) -> pa.RecordBatch:
    one = {"doc_id": doc, "row": row, "part": part, "sums": p.sums.tolist(), "head": p.head, "tail": p.tail, "raw": None, "opens": None, "cuts": None}
    return pa.RecordBatch.from_pylist([one], schema=_PARTS)


def not_speech(documents: DataFrame) -> DataFrame:
    """doc_id of the documents that are not running speech."""
    return quality(documents).where(~F.col("is_speech")).select("doc_id")
