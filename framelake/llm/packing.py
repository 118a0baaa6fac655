"""Packing: order-preserving dynamic programming over window cuts.

Documents keep the order of their input partition, which is one stream of tokens. A window of n tokens wastes LIMIT - n tokens
of padding, or none where n is a power of two; a cut at a document's end costs nothing more, at a sentence's end a little; there
are no others, but for places every STRIDE tokens in a sentence that is longer than a window, which cost more. cost[j] = min over the LIMIT tokens before j of cost[i] + waste(i, j) + cut(j);
as waste grows by one a token, cost[i] + place[i] in a monotone queue gives the best i in constant time, and the few powers of
two are looked up. Streams are cut into stretches of bounded size, whose last window goes on into the next, so memory does not
grow with documents or partitions, and nothing is shuffled. A lost task is run again on the same split and gives the same rows.

Null and empty texts are documents of one token, the end mark. Repeated rows are packed each. Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import kept, table

LIMIT, STRIDE, STRETCH, WORDS_KEPT = 1024, 64, 1 << 17, 150_000
#: Powers of two below the limit that are left unpadded, down to 64 tokens; shorter windows would be too many.
HALVINGS = 4
#: In tokens: what a window, a cut at a sentence's end and a cut elsewhere cost beside the padding.
WINDOW, SENTENCE, INNER = 16, 2, 12
SCHEMA = "d string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A space before another character always starts a token: cutting there leaves the tokens as they are.
SPACE = r" (?=\S)"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts, equal to those of the tokenizer; words met before come from a table of bounded size.

    Text is cut at spaces that start a token and at single line ends between other characters, which are tokens. Words of
    letters alone are merged by the same ranks without the pattern; texts with a special token's string go to the tokenizer.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocab = json.loads(self.whole.to_str())["model"]["vocab"]
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        #: The byte of each letter of the vocabulary: printable bytes stand for themselves, the others for 256 and on, in order.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(byte[c] for c in word): k for word, k in vocab.items() if word not in special}
        ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.merge, self.match = ranked._encode_single_piece, ranked.encode_ordinary
        self.special = [s for s in special if s]
        self.after: dict[str, bytes] = {}  # words after a space
        self.first: dict[str, bytes] = {}  # words after no space
        self.ends = {k for word, k in vocab.items() if word.rstrip("\"')]}")[-1:] in (".", "!", "?") or "Ċ" in word}
        self.space = re.compile(SPACE)
        self.odd = re.compile(r" (?=\s|\Z)")
        self.line = re.compile(r"(?<=\S)\n(?=\S)")

    def size(self) -> int:
        return self.whole.get_vocab_size()

    def word(self, w: str, spaced: bool) -> bytes:
        table = self.after if spaced else self.first
        got = table.get(w)
        if got is None:
            full = " " + w if spaced else w
            if w.isalpha():
                got = packed(self.merge(full.encode()))
            elif len(w) > 1 and w[-1] in ".,!?" and w[:-1].isalpha():
                got = self.word(w[:-1], spaced) + self.word(w[-1], False)
            elif "\n" in w and len(lines := self.line.split(w)) > 1:
                return self.word("\n", False).join([self.word(lines[0], spaced), *[self.word(x, False) for x in lines[1:]]])
            else:
                got = packed(self.match(full))
            if len(table) < WORDS_KEPT and len(w) < 64:
                table[w] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        parts = self.space.split(text) if self.odd.search(text) else text.split(" ")
        got = [self.word(parts[0], False) if parts[0] else b"", *map(self.after.get, parts[1:])]
        if None in got:
            word = self.word
            got = [word(w, True) if g is None else g for g, w in zip(got, parts, strict=True)]
        return b"".join(got)


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def cuts(places, costs, limit: int = LIMIT, halvings: int = 2) -> list[int]:
    """Indexes of the chosen places, first and last included. places: numpy, rising by limit at most; costs: of cutting at each.

    Windows of limit / 2, and so on for so many halvings, need no padding.
    """
    import numpy as np

    n = len(places)
    best, back = [0.0] * n, [0] * n
    before = []
    for power in (limit >> s for s in range(1, halvings + 1)):  # windows of these sizes need no padding
        if power and power & (power - 1) == 0:
            k = np.searchsorted(places, places - power)
            before.append(np.where(places[k] == places - power, k, -1).tolist())
    place, cost = places.tolist(), (costs + WINDOW).tolist()
    values, index = [place[0]] * (n + 1), [0] * (n + 1)  # the queue: best + place, rising, and where it is
    head, tail = 0, 1
    for j in range(1, n):
        p = place[j]
        low = p - limit
        while place[index[head]] < low:
            head += 1
        i = index[head]
        value = values[head] + limit - p
        for of in before:
            k = of[j]
            if k >= 0 and best[k] < value:
                value, i = best[k], k
        value += cost[j]
        best[j], back[j] = value, i
        value += p
        while tail > head and values[tail - 1] >= value:
            tail -= 1
        values[tail], index[tail] = value, j
        tail += 1
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def candidates(ids, ends, documents, limit: int = LIMIT):
    """Places where a stretch may be cut, rising by limit at most, and what a cut there costs. documents: places of their ends."""
    import numpy as np

    n = len(ids)
    cost = np.full(n + 1, np.inf)
    cost[np.flatnonzero(ends[ids]) + 1] = SENTENCE
    cost[documents] = 0
    cost[0] = cost[n] = 0
    places = np.flatnonzero(np.isfinite(cost))
    # Only a sentence longer than a window is cut within.
    for k in np.flatnonzero(np.diff(places) > limit):
        cost[places[k] + STRIDE : places[k + 1] : STRIDE] = INNER
    places = np.flatnonzero(np.isfinite(cost))
    return places, cost[places]


def pieces(stream: Iterator[tuple[object, bytes]], ends, first: int, limit: int = LIMIT, stretch: int = STRETCH) -> Iterator[list[tuple]]:
    """Rows of SCHEMA for a stream of (doc, ids), a list for each stretch. first: the id of the first sequence."""
    import numpy as np

    docs: list[tuple[object, int, int, int]] = []  # doc, place of its first token in the buffer (may be before it), tokens
    buffer, sequence, done = bytearray(), first, False
    stream = iter(stream)
    while not done:
        while len(buffer) < 4 * stretch:
            item = next(stream, None)
            if item is None:
                done = True
                break
            docs.append((item[0], len(buffer) // 4, len(item[1]) // 4))
            buffer += item[1]
        total = len(buffer) // 4
        if not total:
            break
        ids = np.frombuffer(bytes(buffer), "<u4")
        stops = np.array([a + n for _, a, n in docs])
        places, costs = candidates(ids, ends, stops, limit)
        chosen = places[cuts(places, costs, limit, HALVINGS)].tolist()
        if not done and len(chosen) > 2:
            chosen.pop()  # the last window goes on
        end = chosen[-1]
        marks = sorted({*chosen, *(int(x) for x in stops if x <= end)})
        raw, rows, d, w = memoryview(bytes(buffer)), [], 0, 0
        for a, b in zip(marks, marks[1:], strict=False):
            while docs[d][1] + docs[d][2] <= a:
                d += 1
            while chosen[w + 1] <= a:
                w += 1
            doc, begin, n = docs[d]
            rows.append((doc, a - begin, b - a, zlib.crc32(raw[4 * a : 4 * b]), n, sequence + w, a - chosen[w]))
        sequence += len(chosen) - 1
        docs = [(doc, a - end, n) for doc, a, n in docs if a + n > end]
        buffer = bytearray(buffer[4 * end :])
        yield rows


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pieces of all documents (doc_id, text). path: the tokenizer's file, readable on every executor."""
    path = path or vocabulary()

    def run(frames: Iterator):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        encoder = kept(f"encoder {path}", lambda: Encoder(path))
        ends = np.zeros(encoder.size() + 1, bool)
        ends[list(encoder.ends)] = True
        mark = np.zeros(1, "<u4").tobytes()
        stream = ((d, encoder.encode(t or "") + mark) for f in frames for d, t in zip(f["d"], f["text"], strict=True))
        for rows in pieces(stream, ends, TaskContext.get().partitionId() << 32, limit):
            for k in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[k : k + 10_000], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    # Ids travel as text: pandas would turn longs with nulls into doubles.
    rows = docs.select(F.col("doc_id").cast("string").alias("d"), "text").mapInPandas(run, SCHEMA)
    return rows.withColumn("d", F.col("d").cast("long")).withColumnRenamed("d", "doc_id")


def op2_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
