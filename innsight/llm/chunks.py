"""Texts as codes of distinct chunks, column-wise, so that a tokenizer sees each distinct chunk once.

A chunk boundary is only set where every split pattern in use here has one:
for byte-level patterns before a single space between two characters that are
not white space (the space stays with what follows) and on both sides of a single
line break between two such characters, for patterns that drop
white space at any ASCII white space; and between a letter or digit and the punctuation that ends
a chunk.  Encoding the chunks one by one then gives the ids of the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# fixed values: the Unicode white space characters and the four separators
# U+001C-U+001F, as an RE2 class
_WS = "\\t-\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_MARK = "\x00"
# every pattern in use ends a run of letters or digits before these
_PUNCTUATION = ".,;:!?"
_ENDS = rf"[\p{{L}}\p{{N}}][{_PUNCTUATION}]+$"

#: Bytes of text that are worked on at once (a longer single text is worked on alone).
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes in ``column``; NULL texts become empty."""
    at = batch.schema.get_field_index(column)
    batch = batch.set_column(at, column, pc.fill_null(batch.column(at), "" if pa.types.is_string(batch.column(at).type) else b""))
    sizes = pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, used = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and used + n > most:
            pa.default_memory_pool().release_unused()  # what the slice before held
            yield batch.slice(begin, i - begin)
            begin, used = i, 0
        used += n
    if begin < len(sizes):
        pa.default_memory_pool().release_unused()
        yield batch.slice(begin)


def _spaced(texts: pa.Array) -> pa.Array:
    """Lists of chunks, each but the first of a text with its leading space."""
    marked = pc.match_substring(texts, _MARK)
    if pc.any(marked).as_py():  # the marker itself occurs: such a text stays one chunk
        rows = marked.to_numpy(zero_copy_only=False)
        out = _spaced(texts.filter(pc.invert(marked)))
        whole = texts.filter(marked)
        whole = pa.ListArray.from_arrays(pa.array(range(len(whole) + 1), pa.int32()), whole)
        place = np.argsort(np.concatenate([np.flatnonzero(~rows), np.flatnonzero(rows)]), kind="stable")
        return pa.concat_arrays([out, whole]).take(pa.array(place))
    uneven = pc.match_substring_regex(texts, f"^\n|\n$|[ \n][{_WS}]|[{_WS}][ \n]")
    plain = pc.replace_substring(pc.replace_substring(texts, " ", _MARK + " "), "\n", f"{_MARK}\n{_MARK}")
    if pc.any(uneven).as_py():
        rows = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        careful = pc.replace_substring_regex(texts.take(pa.array(rows)), f"([^{_WS}]) ([^{_WS}])", rf"\1{_MARK} \2")
        careful = pc.replace_substring_regex(careful, f"([^{_WS}{_MARK}])\n([^{_WS}])", f"\\1{_MARK}\n{_MARK}\\2")
        plain = pc.replace_with_mask(plain, uneven, careful)
    return pc.split_pattern(plain, _MARK)


def chunked(texts: pa.Array, spaces: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each chunk, first chunk of each text and the end, distinct chunks)."""
    lists = _spaced(texts) if spaces else pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], coded.dictionary


def gathered(codes: np.ndarray, rows: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``flat`` runs by code: (values, first value of each text and the end)."""
    begin = starts[codes]
    n = starts[codes + 1] - begin
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    at = np.repeat(begin - ends[:-1], n)
    at += np.arange(ends[-1])
    return flat[at], ends[rows]


class WordIds:
    """Ids of distinct chunks by the tokenizers library.

    A worker process keeps the chunks it has seen, up to ``limit``, column-wise
    (some 30 bytes each).  New chunks are encoded many to a call, as one text in
    which a separator that no plain chunk can contain stands between them; its id
    tells them apart again.  A chunk with white space (but for its one leading
    space) or with the separator goes alone.
    """

    _made: dict = {}

    def __init__(self, spec: str, spaces: bool, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_str(spec)
        self._tok.encode_special_tokens = True
        self._limit = limit
        # byte-level: a line break is a token of its own before a chunk; else a control character as a word
        self._between = "\n" if spaces else " \x01 "
        self._mark = self._tok.encode(self._between.strip(" "), add_special_tokens=False).ids
        self._odd = f"[{_WS}\\x{{01}}]" if not spaces else f"(?s)^.+[{_WS}]|^[{_WS.replace(' ', '')}]|^ $"
        self._joins = len(self._mark) == 1
        self._forget()

    def _forget(self) -> None:
        self._words = pa.array([], pa.string())
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @classmethod
    def of(cls, key: str, spec: str, spaces: bool) -> WordIds:
        """One per worker process and tokenizer file."""
        if (key, spaces) not in cls._made:
            cls._made[key, spaces] = cls(spec, spaces)
        return cls._made[key, spaces]

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) by the tokenizer."""
        lens = np.zeros(len(words), np.int64)
        odd = pc.match_substring_regex(words, self._odd).to_numpy(zero_copy_only=False) if self._joins else np.ones(len(words), bool)
        odd |= pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(plain), 2_000):
            at = plain[i : i + 2_000]
            text = self._between.join(words.take(pa.array(at)).to_pylist())
            ids = np.array(self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self._mark[0])
            assert len(marks) == len(at) - 1
            parts.append((at, np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1))
        alone = np.flatnonzero(odd)
        if len(alone):
            each = [e.ids for e in self._tok.encode_batch_fast(words.take(pa.array(alone)).to_pylist(), add_special_tokens=False)]
            parts.append((alone, np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each])))
        for at, _, n in parts:
            lens[at] = n
        out, starts = np.empty(lens.sum(), np.uint32), np.cumsum(lens) - lens
        for at, ids, n in parts:
            out[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, lens

    def _places(self, words: pa.Array) -> np.ndarray:
        """Place of each distinct word among the known ones; ``flat[starts[i]:starts[i + 1]]`` are its ids."""
        place = pc.index_in(words, value_set=self._words)
        if place.null_count and len(self._words) + place.null_count > self._limit:
            self._forget()
            place = pc.index_in(words, value_set=self._words)
        if not place.null_count:
            return place.to_numpy(zero_copy_only=False).astype(np.int64)
        new = words.filter(pc.is_null(place))
        ids, lens = self._encode(new)
        first = len(self._words)
        self._words = pa.concat_arrays([self._words, new])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lens)])
        self.flat = np.concatenate([self.flat, ids])
        known = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        known[pc.is_null(place).to_numpy(zero_copy_only=False)] = first + np.arange(len(new))
        return known

    def __call__(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct chunks, first id of each and the end); a word is encoded once, whatever punctuation ends the chunk."""
        ends = pc.match_substring_regex(chunks, _ENDS).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(ends)
        whole = chunks.take(pa.array(at))
        stems = pc.utf8_rtrim(whole, _PUNCTUATION)
        tails = pc.replace_substring_regex(whole, rf"(?s)^.*[^{_PUNCTUATION}]", "")
        parts = pa.concat_arrays([pc.replace_with_mask(chunks, pa.array(ends), stems), tails]).dictionary_encode()
        place = self._places(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)]
        # each chunk's first part, then its tail
        first = np.concatenate([[0], np.cumsum(1 + ends)])
        order = np.empty(len(chunks) + len(at), np.int64)
        order[first[:-1]], order[first[at] + 1] = place[: len(chunks)], place[len(chunks) :]
        return gathered(order, first, self.flat, self.starts)


def encoded(texts: pa.Array, words: WordIds, spaces: bool, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, first id of each text and the end), ``end_id`` appended to each text."""
    codes, rows, distinct = chunked(texts, spaces)
    ids, at = gathered(codes, rows, *words(distinct))
    if end_id is not None:
        ids = np.insert(ids, at[1:], np.uint32(end_id))
        at = at + np.arange(len(at))
    return ids, at
