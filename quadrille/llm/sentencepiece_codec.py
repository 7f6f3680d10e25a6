"""Operator 4: SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import documents, released, slices, with_fields

SPACE = "▁"
_BLANK, _LINE = 32, 10
_KEY = 8  # bytes by which suffixes are ordered


def default_model() -> str:
    """Path of the public tokenizer's model file; TOKENIZERS_DIR can name another folder."""
    folder = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
    return f"{folder}/piece_bpe_32k.model"


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] numbers, then count[1] from begin[1], and so on."""
    return np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)


def _keys(text: np.ndarray, n: int) -> np.ndarray:
    """The first _KEY bytes of each of n suffixes, as numbers that sort like the bytes."""
    key = np.zeros(n, dtype=np.uint64)
    for j in range(_KEY):
        key <<= np.uint64(8)
        key |= text[j : j + n]
    return key


class Codec:
    """A BPE SentencePiece model with byte fallback: encoding and decoding of whole batches."""

    def __init__(self, model: str | bytes) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = size = lib.get_piece_size()
        self.byte_id = np.zeros(256, dtype=np.int32)
        rank: dict[str, int] = {}
        raws = []
        for i in range(size):
            piece = lib.id_to_piece(i)
            raw = piece.replace(SPACE, " ").encode()
            if lib.is_byte(i):
                raw = bytes([int(piece[3:5], 16)])
                self.byte_id[raw[0]] = i
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                raw = b""
            else:
                rank[piece] = i
            raws.append(raw)
        self.out_len = np.array([len(r) for r in raws], dtype=np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out_bytes = np.frombuffer(b"".join(raws), dtype=np.uint8)
        #: What is merged first: the higher score, as the library has it.
        self.order = {p: -lib.get_score(i) for p, i in rank.items()}
        self.known = np.zeros(0x110000, dtype=bool)
        self.known[[ord(p) for p in rank if len(p) == 1 and p != "\n"]] = True
        self.known[ord(" ")] = self.known[ord(SPACE)]
        split = {p: self._merged(list(p)) for p in rank if "\n" not in p}
        alone = sorted(p for p, (parts, _) in split.items() if parts == [p])
        pieces = [p.replace(SPACE, " ").encode() for p in alone]
        self.piece_ids = np.array([rank[p] for p in alone], dtype=np.int64)
        self.piece_len = np.array([len(p) for p in pieces], dtype=np.int64)
        self.id_len = np.zeros(size, dtype=np.int64)
        self.id_len[self.piece_ids] = self.piece_len
        self.width = int(self.piece_len.max()) + _KEY
        #: Least and greatest key of a suffix that begins with the piece; bytes of the pieces, of which long ones are compared beyond the key.
        self.low = np.array([int.from_bytes(p[:_KEY].ljust(_KEY, b"\0"), "big") for p in pieces], dtype=np.uint64)
        self.high = np.array([int.from_bytes(p[:_KEY].ljust(_KEY, b"\xff"), "big") for p in pieces], dtype=np.uint64)
        self.piece_bytes = np.zeros((len(pieces), self.width), dtype=np.uint8)
        for i, p in enumerate(pieces):
            self.piece_bytes[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
        # how pieces come about: the rank of the merge that makes a piece, and what it joins; letters have rank -1
        scores = np.unique(np.array(list(self.order.values())))
        self.made = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.odd = np.zeros(size, dtype=bool)
        own = set(alone)
        for p in sorted(alone, key=len):
            if len(p) > 1:
                (a, b), i = split[p][1], rank[p]
                self.made[i] = np.searchsorted(scores, self.order[p])
                self.left[i], self.right[i] = rank[a], rank[b]
                self.odd[i] = self.odd[rank[a]] or self.odd[rank[b]] or max(self.made[rank[a]], self.made[rank[b]]) >= self.made[i]
        joins = sorted((rank[p[:k]] * size + rank[p[k:]], int(np.searchsorted(scores, self.order[p]))) for p in rank for k in range(1, len(p)) if p[:k] in own and p[k:] in own)
        self.join_codes = np.array([c for c, _ in joins], dtype=np.int64)
        self.join_ranks = np.array([r for _, r in joins], dtype=np.int64)
        self.names = {i: p for p, i in rank.items()}

    def _merged(self, parts: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Pair merging as the model defines it, for short strings: best score first, leftmost of equals; and the last pair that was merged."""
        parts, last = list(parts), None
        while len(parts) > 1:
            best = min(((self.order[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in self.order), default=None)
            if best is None:
                break
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of pieces stay pairs: merging their letters together gives the two pieces again.

        Goes back through the merges that make the two, the latest first. At
        each stage what stand side by side are the end of the one and the
        beginning of the other; if those make a piece that comes before the
        merge just undone, they would have been joined. Pieces that are made
        before their parts would be (none in usual models) are merged letter by
        letter instead.
        """
        out = np.ones(len(left), dtype=bool)
        odd = self.odd[left] | self.odd[right]
        for k in np.flatnonzero(odd):
            a, b = self.names[int(left[k])], self.names[int(right[k])]
            out[k] = self._merged(list(a + b))[0] == [a, b]
        at = np.flatnonzero(~odd)
        a, b, limit = left[at], right[at], np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            code = a * self.size + b
            found = np.minimum(np.searchsorted(self.join_codes, code), len(self.join_codes) - 1)
            joined = (self.join_codes[found] == code) & (self.join_ranks[found] < limit)
            out[at[joined]] = False
            first, second = self.made[a], self.made[b]
            more = ~joined & ((first >= 0) | (second >= 0))
            undo = first > second  # of equal merges the left one comes first, so the right one is undone first
            limit = np.where(undo, first, second + 1)[more]
            a, b, at = np.where(undo, self.right[a], a)[more], np.where(undo, b, self.left[b])[more], at[more]
        return out

    def _edges(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of all pieces, as (position, piece number): a suffix array of the text, and each piece's range in it by binary search."""
        padded = np.concatenate([text, np.full(self.width, _LINE, dtype=np.uint8)])
        key = _keys(padded, len(text))[starts]
        array = np.argsort(key)
        ordered = key[array]
        low = np.searchsorted(ordered, self.low, "left")
        count = np.searchsorted(ordered, self.high, "right") - low
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        start = starts[array[_spread(low, count)]]
        # pieces longer than the key: what follows is compared byte by byte
        good, far = np.ones(len(piece), dtype=bool), np.flatnonzero(self.piece_len[piece] > _KEY)
        j = _KEY
        while len(far):
            same = padded[start[far] + j] == self.piece_bytes[piece[far], j]
            good[far[~same]] = False
            j += 1
            far = far[same & (self.piece_len[piece[far]] > j)]
        return start[good].astype(np.int32), piece[good]

    def _coded(self, text: np.ndarray, sizes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of known letters, laid one after another with a line end behind each; and how many ids each unit has."""
        begin = np.cumsum(sizes + 1) - sizes - 1
        letters = np.flatnonzero(((text & 0xC0) != 0x80) & (text != _LINE))
        start, piece = self._edges(text, letters)
        end = start + self.piece_len.astype(np.int32)[piece]
        unit = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)[start]
        # relax: edges in the order of the place within their unit where they end
        step = end - begin.astype(np.int32)[unit]
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
        start, end, ids, step, unit = start[order], end[order], self.piece_ids[piece[order]], step[order], unit[order]
        cuts = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
        last = np.full(len(text) + 1, -1, dtype=np.int64)  # id of the last piece of the encoding that ends here
        codes, stay = pairs
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, e, t = start[a:b], end[a:b], ids[a:b]
            first = s == begin[unit[a:b]]
            last[e[first]] = t[first]
            s, e, t = s[~first], e[~first], t[~first]
            if len(s):
                code = last[s] * self.size + t
                at = ((code * 0x9E3779B97F4A7C1) >> 20) & (len(codes) - 1)
                good, new = stay[at], np.flatnonzero(codes[at] != code)
                if len(new):
                    fresh, of = np.unique(code[new], return_inverse=True)
                    good[new] = self.stays(fresh // self.size, fresh % self.size)[of]
                    # slots are told apart by writing the number of a row: where several want one, the last has it
                    codes[at[new]] = new
                    owner = codes[at[new]] == new
                    codes[at[new[owner]]], stay[at[new[owner]]] = code[new[owner]], good[new[owner]]
                last[e[good]] = t[good]
        # walk back from the ends of all units together
        at, who, found_unit, found_id = begin + sizes, np.arange(len(sizes)), [], []
        while len(who):
            t = last[at]
            found_unit.append(who)
            found_id.append(t)
            at = at - self.id_len[t]
            more = at > begin[who]
            at, who = at[more], who[more]
        owner, ids = np.concatenate(found_unit), np.concatenate(found_id)
        order = np.argsort(owner[::-1], kind="stable")
        return ids[::-1][order].astype(np.int32), np.bincount(owner, minlength=len(sizes))

    def _units(self, units: list[bytes], pairs: tuple[np.ndarray, np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after another, and how many each has. Letters without a piece become the ids of their bytes, and what is between them stands alone."""
        letters = np.frombuffer(b"\n".join([b"\0" if u == b"\n" else u for u in units]).decode().encode("utf-32-le"), dtype=np.uint32)
        strange = np.flatnonzero(~self.known[letters] & (letters != _LINE))
        odd = np.unique(np.searchsorted(np.flatnonzero(letters == _LINE), strange)).tolist()
        todo, parts = list(units), {}
        for i in odd:  # known runs of such a unit are encoded as units of their own, at the end of the list
            parts[i], todo[i] = [], b""
            for known, run in itertools.groupby(units[i].decode(), lambda c: self.known[ord(c)]):
                run = "".join(run).encode()
                parts[i].append(len(todo) if known else self.byte_id[np.frombuffer(run, dtype=np.uint8)])
                if known:
                    todo.append(run)
        sizes = np.array([len(u) for u in todo], dtype=np.int64)
        found = [np.zeros(0, dtype=np.int32)]
        counts = np.zeros(len(todo), dtype=np.int64)
        full = np.flatnonzero(sizes)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[full]) // block, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(full)]):
            own = full[a:b]
            ids, n = self._coded(np.frombuffer(b"\n".join([todo[i] for i in own]) + b"\n", dtype=np.uint8), sizes[own], pairs)
            found.append(ids)
            counts[own] = n
        ids = np.concatenate(found)
        if not odd:
            return ids, counts
        begin = np.cumsum(counts) - counts
        pieces, at = [], 0
        for i in odd:
            pieces += [ids[begin[at] : begin[i]], *(ids[begin[x] : begin[x] + counts[x]] if isinstance(x, int) else x for x in parts[i])]
            at = i + 1
        pieces.append(ids[begin[at] : begin[len(units) - 1] + counts[len(units) - 1]] if at < len(units) else ids[:0])
        for i in odd:
            counts[i] = sum(counts[x] if isinstance(x, int) else len(x) for x in parts[i])
        return np.concatenate(pieces), counts[: len(units)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """A table by hash of pairs of pieces and whether they stay; later pairs replace earlier ones."""
        return np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)

    def encode(self, texts: pa.Array, pairs: tuple[np.ndarray, np.ndarray] | None = None, block: int = 1 << 18) -> pa.ListArray:
        """Ids of each text, equal to those of the library. Null and empty texts have none.

        A unit is what no piece goes beyond: blanks and the letters after them,
        or blanks alone, or a line end. The batch's distinct units are its
        text, indexed in blocks of about so many bytes.
        """
        pairs = pairs or self.pairs()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        whole = b"".join(b" " + t for t in texts.cast(pa.large_binary()).to_pylist() if t)
        text_begin = np.cumsum(np.where(sizes > 0, sizes + 1, 0)) - np.where(sizes > 0, sizes + 1, 0)
        buf = np.frombuffer(whole, dtype=np.uint8)
        n_texts = len(sizes)
        if not len(buf):
            return pa.ListArray.from_arrays(pa.array(np.zeros(n_texts + 1, dtype=np.int32)), pa.array(np.zeros(0, dtype=np.int32)))
        if b"\xe2\x96\x81" in whole:  # the mark itself is a blank
            mark = (buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)
            gone = np.zeros(len(buf), dtype=bool)
            at = np.flatnonzero(mark)
            gone[at + 1] = gone[at + 2] = True
            buf = buf.copy()
            buf[at] = _BLANK
            text_begin = text_begin - np.append(0, np.cumsum(gone))[text_begin]
            buf = buf[~gone]
        blank, line = buf == _BLANK, buf == _LINE
        new = np.zeros(len(buf), dtype=bool)
        new[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
        new[text_begin[sizes > 0]] = True
        at = np.flatnonzero(new)
        cuts = pa.py_buffer(np.append(at, len(buf)).astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, cuts, pa.py_buffer(buf)]).dictionary_encode()
        number = np.asarray(coded.indices)
        ids, counts = self._units(coded.dictionary.to_pylist(), pairs, block)
        begin = np.cumsum(counts) - counts
        each = counts[number]
        out = ids[_spread(begin[number], each)]
        ends = np.append(0, np.cumsum(each))
        cut = ends[np.searchsorted(at, np.append(text_begin, len(buf)))]
        return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(out))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of ids: pieces with blanks for their marks, bytes read as UTF-8; the blank put before the text goes. No ids give an empty text, null ids a null one."""
        flat = np.asarray(pc.fill_null(ids.flatten(), 0), dtype=np.int64)
        counts = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), dtype=np.int64)
        each = self.out_len[flat]
        buf = self.out_bytes[_spread(self.out_at[flat], each)]
        ends = np.append(0, np.cumsum(np.append(0, np.cumsum(each))[np.cumsum(counts)] - np.append(0, np.cumsum(each))[np.cumsum(counts) - counts]))
        lead = ends[:-1][(np.diff(ends) > 0)]
        lead = lead[buf[lead] == _BLANK]
        keep = np.ones(len(buf), dtype=bool)
        keep[lead] = False
        ends = ends - np.append(0, np.cumsum(~keep))[ends]
        buf = buf[keep]
        null = None if not ids.null_count else pa.py_buffer(np.packbits(np.asarray(ids.is_valid()), bitorder="little"))
        out = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf)), null)
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), out.buffers()).to_pylist()
            return pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())
        return out.cast(pa.string())


def _codec(spark: SparkSession, model: str | None):
    """The model's tables (a few MB whatever the data), made on the driver and sent to the executors: the file is needed on the driver only."""
    return spark.sparkContext.broadcast(Codec(model or default_model()))


def encode(docs: DataFrame, *, model: str | None = None, batch_bytes: int = 2 << 20) -> DataFrame:
    """SentencePiece ids of every text: doc_id, ids (array<int>), one row per row of docs.

    The model is BPE with byte fallback and no normalisation. A batch's text,
    about batch_bytes, is cut in units (blanks and the letters after them; no
    piece spans two), of which equal ones are laid down once. A suffix array
    of that concatenation is built, ordered by eight bytes; every piece's
    occurrences are a range of it, found by binary search (and compared
    further, for longer pieces); they are the edges of a lattice. Edges, sorted
    by the place where they end, are relaxed: the last piece of the encoding up
    to a place is the one edge that stays intact next to the last piece of the
    encoding up to its start. This gives the ids that merging gives, as tests
    hold against the library.

    docs needs doc_id and text; other columns are ignored. Null and empty
    texts have no ids; texts of any length are encoded whole.
    """
    sent = _codec(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value
        pairs = codec.pairs()
        for batch in batches:
            for part in slices(batch, size=batch_bytes):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), codec.encode(part.column("text"), pairs)], names=["doc_id", "ids"])
        del pairs
        released()

    return docs.select("doc_id", "text").mapInArrow(run, with_fields(docs.select("doc_id"), "ids array<int>"))


def decode(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """Adds the column text, in place of one that is there, to a table with ids; null ids give a null text, no ids an empty one."""
    encoded = encoded.drop("text")
    sent = _codec(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                yield pa.RecordBatch.from_arrays([*part.columns, codec.decode(part.column("ids"))], names=[*part.schema.names, "text"])
        released()

    return encoded.mapInArrow(run, with_fields(encoded, "text string"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents and decodes them again; ids and texts are given as digests."""
    out = decode(encode(documents(spark, sf_dir)))
    ids = F.sha2(F.array_join("ids", " ").cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), ids.alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
