"""Token ids of whole batches of texts, by byte-level BPE vocabularies.

Byte-level BPE never merges across the start of a blank that stands between two
characters that are not white space, so a text may be cut there and each
distinct piece be tokenised once. Arrow cuts the texts and numbers the distinct
pieces; only pieces not seen before reach the tokenizer, joined to one text,
and numpy puts the ids together. Texts with other white space around a blank
are tokenised whole. Tokens that the ``tokenizers`` file of the same vocabulary
adds to the ranks, such as the end of a document, are found in texts as that
file finds them. Tests compare the ids of the two.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: White space of the splitting pattern and of Python, as a class for RE2.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = f" {_SPACE}|{_SPACE} "

#: Bytes of text that are put together at a time.
GROUP = 4_000_000


class Encoder:
    """``ranks`` is the path of a rank file, or its name among the public
    tokenizers; the added tokens are read from the JSON file beside it, if there
    is one. ``cached`` distinct pieces are remembered at most; when there are
    more, the memory starts anew."""

    def __init__(self, ranks: str = "byte_bpe_50k.tiktoken", cached: int = 600_000):
        path = ranks if os.path.isabs(ranks) else public_tokenizers.path(ranks)
        with open(path, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        beside = os.path.splitext(path)[0] + ".json"
        added: dict[str, int] = {}
        if os.path.exists(beside):
            with open(beside, encoding="utf-8") as file:
                added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        # the ranks may hold an added token under its own bytes
        table = {k: v for k, v in table.items() if v not in added.values()}
        self.encoding = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
        widths = {v: len(k) for k, v in table.items()} | {v: len(k.encode()) for k, v in added.items()}
        self.widths = np.zeros(max(widths) + 1, np.int64)
        self.widths[list(widths)] = list(widths.values())
        self.cached = cached
        self._forget()

    def _forget(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        # the list form takes lone surrogates, which a numpy form does not
        return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)

    def _learn(self, pieces: pa.Array) -> None:
        """Ids of new pieces, which all follow a blank."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")
        ids = self._whole(" " + joined[0].as_py())
        ends = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
        cut = np.searchsorted(np.cumsum(self.widths[ids]), ends, "left") + 1
        lengths = np.diff(cut, prepend=0)
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.starts = np.concatenate((self.starts, len(self.ids) + cut - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids per text; a null text has none."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        uneven = pc.fill_null(pc.match_substring_regex(texts, _UNEVEN), True).to_numpy(zero_copy_only=False)
        for at in np.flatnonzero(uneven).tolist():
            if texts[at].is_valid:
                out[at] = self._whole(texts[at].as_py())
        even = np.flatnonzero(~uneven)
        # in groups of bounded text, whatever the batch
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)[even])
        for group in np.split(even, np.searchsorted(sizes, np.arange(GROUP, sizes[-1] if len(sizes) else 0, GROUP))):
            if len(group):
                for at, ids in zip(group.tolist(), self._pieces(texts.take(pa.array(group))), strict=True):
                    out[at] = ids
        return out

    def _pieces(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary
        if len(self.pieces) > self.cached:
            self._forget()
        found = pc.index_in(distinct, value_set=self.pieces)
        known = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            new = known < 0
            known[new] = np.arange(len(self.pieces), len(self.pieces) + found.null_count)
            self._learn(distinct.filter(found.is_null()))
        place = known[coded.indices.to_numpy()]
        length = self.lengths[place]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        first = np.cumsum(counts) - counts
        # a text's first piece follows no blank
        heads = [self._whole(p.as_py()) for p in split.flatten().take(pa.array(first))]
        length[first] = [len(h) for h in heads]
        ends = np.cumsum(length)
        begins = ends - length
        gather = np.arange(ends[-1]) + np.repeat(self.starts[place] - begins, length)
        for at in first.tolist():
            gather[begins[at] : ends[at]] = 0
        ids = self.ids[gather] if len(self.ids) else np.zeros(len(gather), np.uint32)
        for at, head in zip(first.tolist(), heads, strict=True):
            ids[begins[at] : ends[at]] = head
        return np.split(ids, ends[first + counts - 1][:-1])
