"""Packing of token sequences into windows of fixed capacity by the sum-of-squares rule.

Each document is tokenised and closed with an end id.  Whole windows are cut from it first; what is left goes to the fill
level that makes the sum of squared counts of partly filled windows least (a fresh window is level 0).  The counts live in
an array indexed by level.  Where the open windows of a task reach ``max_open``, and at its end, they are closed: windows
that hold least are dealt out to complete the fullest ones, and the one left over is cut into runs whose lengths are powers
of two, which need no padding.  So each task pads nothing, and whatever the length distribution its memory stays bounded.

Defined cases: a null text is the empty text and packs as its end id alone; a text longer than a window spans several;
repeated rows are packed each; an empty table gives an empty table; further columns are not read.  A document with a null
identifier keeps it null.  Results depend on the order of rows in the partitions read, which a table scan repeats.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MEMO_ENTRIES = 900_000
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Words that the pattern of such tokenizers cuts into one run of letters and at most one run of signs.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch
#: Signs between a letter and white space are a run of their own; parted from their word, they make fewer different words.
SIGNS = ".,;:!?$&%#*+"
CLOSING = r"([a-zß-öø-ÿ])([" + SIGNS + r"]+)([ \n])"
LETTERS = r"^[a-zß-öø-ÿ]+$"


class WordTokenizer:
    """A tokenizer file behind a memo of white-space separated words.

    Right for tokenizers that fold case, drop white space and never look across it; words are cut at ASCII white space only.  Plain
    words are tokenised many at a time as one line and told apart by the tokens that end a word.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        self.memo = common.Memo(MEMO_ENTRIES)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = bool(suffix) and token.endswith(suffix)
        self.bare = self._bare(path) if suffix else None
        parted = [self.tokenizer.encode(f"a{gap}{sign} é{gap}{sign * 3} b", add_special_tokens=False).ids for sign in (*SIGNS, SIGNS) for gap in ("", " ")]
        self.parts_signs = parted[::2] == parted[1::2]

    def _bare(self, path: str):
        """The same model for lower-case words parted by blanks, without the normaliser; None unless it agrees on a probe."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer.from_file(path)
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = "".join(c for c in map(chr, range(65, 256)) if PLAIN(c))
        probe = [letters[i : i + n] for n in (1, 2, 5) for i in range(len(letters))]
        whole, parted = " ".join(f"{w} {w}., {w}!" for w in probe), " ".join(f"{w} {w} ., {w} !" for w in probe).lower()
        same = self.tokenizer.encode(whole, add_special_tokens=False).ids == bare.encode(parted, add_special_tokens=False).ids
        return bare if same else None

    def learn(self, words: list[bytes]) -> None:
        single, plain, parts = [], [], []
        if self.bare:
            text = pa.array(words, pa.large_binary()).cast(pa.large_string())
            alone = pc.match_substring_regex(text, LETTERS).to_numpy(zero_copy_only=False).tolist()
            letters = list(compress(words, alone))
            words = [w for w, a in zip(words, alone) if not a]
            single += self._runs(letters, [b" ".join(letters[i : i + 1024]).decode() for i in range(0, len(letters), 1024)], None)
        for w in words:
            if self.bare and (m := PLAIN(text := w.decode("utf-8", "replace"))):
                plain.append(w)
                parts.append(m.groups())
            else:
                single.append(w)
        lines = [" ".join(f"{a} {b}" for a, b in parts[start : start + 1024]).lower() for start in range(0, len(plain), 1024)]
        single += self._runs(plain, lines, [2 if b else 1 for _, b in parts])
        coded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in single], add_special_tokens=False)
        self.memo.young.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(single, coded))

    def _runs(self, words: list[bytes], lines: list[str], ends: list[int] | None) -> list[bytes]:
        """Learn words from lines of 1024 of them, each of ``ends`` closing tokens (one without); returns what does not fit."""
        left = []
        for start, line in zip(range(0, len(words), 1024), self.bare.encode_batch_fast(lines, add_special_tokens=False) if lines else []):
            part, ids = words[start : start + 1024], np.array(line.ids, "<u4")
            closing = np.flatnonzero(self.closes[ids]) + 1
            last = np.cumsum(ends[start : start + 1024]) - 1 if ends else np.arange(len(part))
            if len(closing) != last[-1] + 1:
                left += part
                continue
            packed, stops = ids.tobytes(), (4 * closing[last]).tolist()
            self.memo.young.update(zip(part, [packed[a:b] for a, b in zip([0, *stops], stops)]))
        return left

    def ids(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Packed ids of each text, its end included.

        A batch is lower-cased, cut into words and reduced to its distinct words by Arrow kernels; only distinct words meet the
        memo, and their packed ids are gathered back in order of the words.
        """
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "").take(pa.array(range(len(texts))))  # a copy: kernels are not to meet a slice's offset
        marked = pc.match_substring(texts, "<|")  # special tokens are told by case
        lowered = pc.ascii_lower(texts)
        texts = pc.if_else(marked, texts, lowered) if pc.any(marked).as_py() else lowered
        if self.parts_signs:
            texts = pc.replace_substring_regex(texts, pattern=CLOSING, replacement=r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        first = lists.offsets.to_numpy()
        words = lists.values.slice(first[0], first[-1] - first[0]).cast(pa.large_binary())
        coded, ends = [], [np.zeros(1, np.int64)]
        for start in range(0, len(words), self.memo.size):
            part = words.slice(start, self.memo.size).dictionary_encode()
            distinct = part.dictionary.to_pylist()
            if fresh := self.memo.unknown(set(distinct)):
                self.learn(fresh)
            taken = pa.array(list(map(self.memo.young.__getitem__, distinct)), pa.large_binary()).take(part.indices)
            at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
            coded.append(memoryview(taken.buffers()[2] or b"")[at[0] : at[-1]])
            ends.append(at[1:] - at[0] + ends[-1][-1])
        whole = coded[0] if len(coded) == 1 else memoryview(b"".join(coded))
        cuts = np.concatenate(ends)[first - first[0]].tolist()
        return [bytes(whole[a:b]) + self.end for a, b in zip(cuts, cuts[1:])]


class Window:
    __slots__ = ("fill", "pieces")

    def __init__(self):
        self.fill, self.pieces = 0, []

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total))
        self.fill += len(ids) // 4

    def give(self, n: int, other: Window) -> None:
        """Move the last ``n`` ids to ``other``, cutting a piece where needed."""
        while n:
            doc, start, ids, total = self.pieces.pop()
            have = len(ids) // 4
            if have > n:
                self.pieces.append((doc, start, ids[: 4 * (have - n)], total))
                start, ids, have = start + have - n, ids[4 * (have - n) :], n
            other.add(doc, start, ids, total)
            self.fill -= have
            n -= have


class SumOfSquares:
    """Online packer; ``take`` and ``close`` return the windows that are finished."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open, self.n_open = capacity, max_open, 0
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[Window]] = [[] for _ in range(capacity + 1)]

    def level_for(self, n: int) -> int:
        """The fill level to put ``n`` ids on: least growth of the sum of squares, the fullest level on a tie."""
        c, count = self.capacity, self.levels
        before, after = count[: c - n + 1], count[n : c + 1]
        growth = 2 * (after - before) + 2
        growth[0] = 2 * count[n] + 1
        growth[c - n] = -2 * before[c - n] + 1  # a full window counts no more
        growth[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return c - n - int(np.argmin(growth[::-1]))

    def take(self, doc, ids: bytes) -> list[Window]:
        done, total, at = [], len(ids) // 4, 0
        while total - at >= self.capacity:
            w = Window()
            w.add(doc, at, ids[4 * at : 4 * (at + self.capacity)], total)
            done.append(w)
            at += self.capacity
        if n := total - at:
            level = self.level_for(n)
            w = self.open[level].pop() if level else Window()
            self.levels[level] -= level > 0
            self.n_open += level == 0
            w.add(doc, at, ids[4 * at :], total)
            if w.fill == self.capacity:
                self.n_open -= 1
                done.append(w)
            else:
                self.open[w.fill].append(w)
                self.levels[w.fill] += 1
        return done + self.close() if self.n_open >= self.max_open else done

    def close(self) -> list[Window]:
        left = [w for level in reversed(self.open) for w in level]
        self.open = [[] for _ in self.open]
        self.levels[:] = 0
        self.n_open, done, first, last = 0, [], 0, len(left) - 1
        while first < last:
            left[last].give(min(self.capacity - left[first].fill, left[last].fill), left[first])
            if left[first].fill == self.capacity:
                done.append(left[first])
                first += 1
            if not left[last].fill:
                last -= 1
        if first == last and left[first].fill:
            rest = left[first]
            while rest.fill & (rest.fill - 1):
                small = Window()
                rest.give(rest.fill & -rest.fill, small)
                done.append(small)
            done.append(rest)
        return done


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, capacity: int = 4096, max_open: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids binary]).

    A map over partitions: no shuffle, nothing on the driver.  A sequence belongs to the partition that made it
    (``sequence_id`` carries the partition's number in its high bits).
    """
    common.ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        if (tokenizer_path, end_id) not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path, end_id] = WordTokenizer(tokenizer_path, end_id)
        tokenizer = _TOKENIZERS[tokenizer_path, end_id]
        common.rare_gc()
        packer, sequence, rows = SumOfSquares(capacity, max_open), TaskContext.get().partitionId() << 40, []

        def table():
            cols = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:7]]
            if with_ids:
                cols.append(pa.array([r[7] for r in rows], pa.binary()))
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*FIELDS, "ids"][: len(cols)])

        def emit(windows):
            nonlocal sequence
            for w in windows:
                offset = 0
                for doc, start, ids, total in w.pieces:
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1

        for batch in batches:
            for part in common.portions(batch, 1):
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer.ids(part.column(1))):
                    emit(packer.take(doc, ids))
                    if len(rows) >= 4096:
                        yield table()
        emit(packer.close())
        if rows:
            yield table()

    schema = ", ".join(f"{f} long" for f in FIELDS) + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("word_bpe_49k.json"))
