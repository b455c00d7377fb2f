"""Batch encoding with a public tokenizer file, with a bounded cache of text units.

A unit is a stretch of text that the tokenizer encodes the same way wherever it stands. Which cuts are safe
follows from the tokenizer file: byte-level vocabularies split before a single space that a non-space follows;
vocabularies that drop white space split at every space. For any other file the unit is the whole text.
Units are looked up by a 64-bit hash in a table of arrays, a batch at a time, and their bytes are compared with those
kept; what is new goes to the tokenizers library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from folio.llm.common import kept, lane_hashes, lanes, slices, spread

_FREE = np.zeros(256, bool)
_FREE[[32, 10]] = True
#: Bytes after a space that are, or may begin, white space.
_SPACY = np.zeros(256, bool)
_SPACY[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class UnitEncoder:
    """Encodes texts to ids; equal to ``Tokenizer.encode(text, add_special_tokens=False)`` text by text.

    At most ``max_units`` units are kept; those that come later are encoded anew each time.
    """

    def __init__(self, path: str, max_units: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.max_units = max_units
        self.kind = self._kind(spec)
        self.slots = 1 << int(2 * max_units - 1).bit_length()
        #: The high half of each unit's hash is enough to find it, as its bytes are compared.
        self.key, self.row = np.zeros(self.slots, np.uint32), np.full(self.slots, -1, np.int32)
        self.known = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int32)
        #: The bytes of the units kept, as lanes, and each unit's length.
        self.lanes, self.lane_at, self.length = np.zeros(1 << 16, np.uint64), np.zeros(max_units + 1, np.int32), np.zeros(max_units, np.int32)
        self.mark = self._mark(spec)

    def _mark(self, spec: dict) -> int | None:
        """The id of a zero byte, where that is one id and no merge touches it."""
        if self.kind == "whole":
            return None
        ids = self.tokenizer.encode("\0", add_special_tokens=False).ids
        merges = (m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"])
        return ids[0] if len(ids) == 1 and not any("\u0100" in m.replace("</w>", "") for m in merges if m != "\u0100 </w>") else None

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "led"
        steps = pre.get("pretokenizers") or []
        drops = steps and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
        if drops and "\\s" in str(steps[0].get("pattern")) and {x.get("type") for x in (norm or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}:
            return "free"
        return "whole"

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units, and the first unit of each text (with a last bound)."""
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if self.kind == "free":
            word = ~_FREE[data]
            start, end = word.copy(), word.copy()
            start[1:] &= ~word[:-1] | edge[1:n]
            end[:-1] &= ~word[1:] | edge[1:n]
            starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        else:
            if self.kind == "led" and n > 1:
                edge[: n - 1] |= (data[:-1] == 32) & ~_SPACY[data[1:]] & ~edge[1:n]
            bounds = np.flatnonzero(edge)
            starts, ends = bounds[:-1], bounds[1:]
        return starts, ends, np.searchsorted(starts, offsets)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 where unknown: open addressing, all keys probed together."""
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        high = (keys >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        while len(live):
            s = slot[live]
            row = self.row[s]
            hit = (row >= 0) & (self.key[s] == high[live])
            out[live[hit]] = row[hit]
            live = live[(row >= 0) & ~hit]
            slot[live] = (slot[live] + 1) & (self.slots - 1)
        return out

    def _keep(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        live = np.arange(len(keys))
        while len(live):
            free = live[self.row[slot[live]] < 0]
            self.row[slot[free]] = rows[free]  # of several for one slot the last stays
            won = free[self.row[slot[free]] == rows[free]]
            self.key[slot[won]] = keys[won] >> np.uint64(32)
            done = np.zeros(len(keys), bool)
            done[won] = True
            live = live[~done[live]]
            slot[live] = (slot[live] + 1) & (self.slots - 1)

    def _encode_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and their counts: most in one text, parted by a byte that no merge touches."""
        led = self.kind == "led"
        apart = [i for i, t in enumerate(texts) if "\0" in t or t[-1].isspace() or (led and t[0] != " ")] if self.mark is not None else range(len(texts))
        lens, flat = np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        if self.mark is not None:
            gone = set(apart)
            rest = [i for i in range(len(texts)) if i not in gone] if gone else range(len(texts))
            glue = "\0" if led else " \0 "
            flat = np.array(self.tokenizer.encode_batch_fast([glue.join([texts[i] for i in rest]) + glue], add_special_tokens=False)[0].ids if len(rest) else [], np.uint32)
            at = np.flatnonzero(flat == self.mark)
            if len(at) != len(rest):
                raise ValueError("a unit's ids hold the mark")
            lens[np.asarray(rest, np.int64)] = np.diff(np.concatenate([[-1], at])) - 1
            flat = flat[flat != self.mark]
        if len(apart):
            found = dict(zip(apart, (x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in apart], add_special_tokens=False)), strict=True))
            parts, top = [], 0
            for i in range(len(texts)):
                if i in found:
                    parts.append(np.array(found[i], np.uint32))
                    lens[i] = len(found[i])
                else:
                    parts.append(flat[top : top + lens[i]])
                    top += lens[i]
            flat = np.concatenate(parts)
        return flat, lens

    def _same(self, rows: np.ndarray, values: np.ndarray, first: np.ndarray, n: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the units (their lanes ``values`` from ``first``, ``n`` each) are those kept in ``rows``, byte for byte."""
        same = (self.length[rows] == length) & (self.lanes[self.lane_at[rows]] == values[first])
        more = np.flatnonzero(same & (n > 1))  # most units are one lane
        if len(more):
            differ = self.lanes[spread(self.lane_at[rows[more]], n[more])] != values[spread(first[more], n[more])]
            same[more] = ~np.logical_or.reduceat(differ, np.cumsum(n[more]) - n[more])
        return same

    def _keep_units(self, values: np.ndarray, n: np.ndarray, length: np.ndarray) -> None:
        top, known = int(self.lane_at[self.known]), self.known
        if top + len(values) > len(self.lanes):
            self.lanes = np.concatenate([self.lanes, np.zeros(max(len(self.lanes) // 2, len(values)), np.uint64)])
        self.lanes[top : top + len(values)] = values
        self.lane_at[known + 1 : known + 1 + len(n)] = top + np.cumsum(n)
        self.length[known : known + len(n)] = length

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text, of texts given as UTF-8 bytes and offsets."""
        starts, ends, first = self._units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        length = ends - starts
        values, n = lanes(data, starts, ends)
        lane = np.cumsum(n) - n
        keys = lane_hashes(values, n, length)
        rows = self._find(keys)
        ids, at = self.ids, self.at
        found = rows >= 0
        if found.all():
            taken = np.flatnonzero(~self._same(rows, values, lane, n, length))
        else:
            known = np.flatnonzero(found)
            taken = known[~self._same(rows[known], values, lane[known], n[known], length[known])]  # another unit with this hash is kept
        missing = np.flatnonzero(~found)
        if len(missing) or len(taken):
            new, where, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            reps = missing[where]
            own = reps[inverse]
            # of the units that share a hash within the batch, those unlike the first are encoded one by one, and not kept
            alike = (length[own] == length[missing]) & (values[lane[own]] == values[lane[missing]])
            pairs = np.flatnonzero(alike & (own != missing) & (n[missing] > 1))
            if len(pairs):
                k = n[missing[pairs]]
                differ = values[spread(lane[own[pairs]], k)] != values[spread(lane[missing[pairs]], k)]
                alike[pairs] = ~np.logical_or.reduceat(differ, np.cumsum(k) - k)
            odd = np.concatenate([missing[~alike], taken])
            raw = data.tobytes()
            todo = np.concatenate([reps, odd])
            flat, lens = self._encode_units([raw[a:b].decode() for a, b in zip(starts[todo].tolist(), ends[todo].tolist(), strict=True)])
            rows[missing] = self.known + inverse
            rows[odd] = self.known + len(reps) + np.arange(len(odd))
            keep = max(min(len(new), self.max_units - self.known), 0)
            top, size = int(at[-1]), int(lens[:keep].sum())
            if top + len(flat) > len(ids):
                ids = np.concatenate([ids, np.zeros(max(len(ids) // 2, len(flat)), np.uint32)])
            ids[top : top + len(flat)] = flat
            at = np.concatenate([at, (top + np.cumsum(lens)).astype(np.int32)])
            if keep:
                self._keep(new[:keep], self.known + np.arange(keep))
                self._keep_units(values[spread(lane[reps[:keep]], n[reps[:keep]])], n[reps[:keep]], length[reps[:keep]])
            self.known += keep
            self.ids, self.at = ids, at[: self.known + 1]
        lens = at[rows + 1] - at[rows]
        total = np.concatenate([[0], np.cumsum(lens)])
        return ids[spread(at[rows], lens)], np.diff(total[first])


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for ``path``, made once."""
    return kept(("encoder", path), lambda: UnitEncoder(path))


def encoded(enc: UnitEncoder, data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 18):
    """(first text, last text, ids, counts) for ranges of texts of about ``limit`` bytes."""
    for a, b in slices(offsets, limit):
        yield a, b, *enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
