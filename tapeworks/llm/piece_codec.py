"""SentencePiece encoding for merge-type vocabularies by a score-ordered agenda, and decoding.

A chunk starts as its characters. An agenda holds every adjacent pair whose concatenation is in the vocabulary, the best
score first and the leftmost among equals; the top pair is merged if both its symbols are still what they were, and the
two new neighbours' pairs are added. Symbols that end up outside the vocabulary become their UTF-8 bytes' pieces.

No piece of the vocabulary holds a space after another character, nor a line feed; this is checked when it is loaded. So
merges never cross the start of a run of spaces or a line feed, a text is encoded in such chunks, and the ids of a chunk
are remembered (up to LIMIT bytes a worker). The new chunks of each Arrow batch are also encoded by the sentencepiece library;
a text with a chunk on which the two differ is encoded by the library as a whole."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_slices

SPACE = "▁"
#: Bytes of chunks kept by a worker, about; characters of a chunk that may recur; bytes of an entry besides its own.
LIMIT, LONG, ENTRY = 192 << 20, 256, 160
NORMAL, UNKNOWN, BYTE = 1, 2, 6


class Agenda:
    """A vocabulary with scores, and the merge procedure."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.adjacent = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces with inner spaces or line feeds: chunks would not be independent")

    def encode(self, chunk: str) -> list[int]:
        symbols, scores = list(chunk), self.scores
        last = len(symbols)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        pairs = [symbols[i] + symbols[i + 1] for i in range(last - 1)]
        agenda = [(-scores[both], i, i + 1, both) for i, both in enumerate(pairs) if both in scores]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if after[a] != b or not symbols[a] or symbols[a] + symbols[b] != both:
                continue  # one of the two has been merged since
            symbols[a], symbols[b] = both, ""
            c, z = after[b], before[a]
            after[a] = c
            if c < last:
                before[c] = a
                if (more := both + symbols[c]) in scores:
                    heapq.heappush(agenda, (-scores[more], a, c, more))
            if z >= 0 and (more := symbols[z] + both) in scores:
                heapq.heappush(agenda, (-scores[more], z, a, more))
        out = []
        for s in filter(None, symbols):
            if s in self.ids:
                out.append(self.ids[s])
            else:
                out += [self.bytes.get(x, self.unknown) for x in s.encode()] if self.bytes else [self.unknown]
        return out


def _packed(ids: list[int]) -> bytes:
    return array("H", ids).tobytes()


class Codec:
    """Encodes and decodes whole texts; one for each worker process."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as form

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = form.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        how = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or how.name != "identity" or how.precompiled_charsmap or how.remove_extra_whitespaces:
            raise ValueError("only merge-type vocabularies with identity normalisation")
        if not how.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix or len(model.pieces) > 1 << 16:
            raise ValueError("only vocabularies with a space before the text, of up to 65,536 pieces")
        self.agenda = Agenda([(p.piece, p.score, p.type) for p in model.pieces])
        self.known: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.odd: set[str] = set()  # chunks on which agenda and library differ
        self.held = 0
        self.decimals = [str(i).encode() for i in range(len(model.pieces))]
        self.feed = len(self.agenda.encode("\n"))
        self.lead = len(self.library.encode("\n")) - self.feed

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, cut before runs of spaces and line feeds: without the first of its spaces, or with its line
        feed. An empty chunk is a lone space before a line feed or the end."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        parts = text.replace("\n", " \n").split(" ") if text else []
        if "" in parts:  # runs of spaces stay with what follows them
            parts = [x.removeprefix(" ") for x in re.findall(" +[^ \n]*|\n[^ \n]*", " " + text)]
        return parts

    def learn(self, missing: set[str]) -> None:
        """Adds the ids of new chunks. A last character that no piece holds next to the one before it is cut off: merges never
        cross that place either, and words recur more often without their punctuation."""
        made, todo = {}, set()
        for chunk in missing:
            if len(chunk) > 1 and chunk[-2] != " " and chunk[-2:] not in self.agenda.adjacent:
                made[chunk] = chunk[:-1]
                if chunk[:-1] not in self.known:
                    todo.add(chunk[:-1])
            else:
                todo.add(chunk)
        order = list(todo)
        spelled = [x if x[:1] == "\n" else SPACE + x.replace(" ", SPACE) for x in order]
        own = [self.agenda.encode(x) for x in spelled]
        # the library puts a space before what it encodes; a chunk with a line feed in front has none
        theirs = self.library.encode([x[1:] if x[0] == SPACE else x for x in spelled], num_threads=1)
        for chunk, shape, a, b in zip(order, spelled, own, theirs, strict=True):
            if shape[0] != SPACE:
                b = b[self.lead :]
            elif shape == SPACE and not b:
                b = a  # the library gives nothing for an empty text; between two others it is one space
            self.check(chunk, a, b)
            self.held += ENTRY + 4 * len(chunk)
            self.known[chunk] = _packed(a)
        for chunk, rest in made.items():
            if (last := self.last.get(chunk[-1])) is None:
                ids = self.agenda.encode(chunk[-1])
                last = _packed(ids)
                if self.check(chunk, ids, self.library.encode("\n" + chunk[-1])[self.lead + self.feed :]):
                    self.last[chunk[-1]] = last
            if rest in self.odd:
                self.odd.add(chunk)
            self.known[chunk] = self.known[rest] + last
            self.held += ENTRY + 4 * len(chunk)

    def check(self, chunk: str, own: list[int], theirs: list[int]) -> bool:
        if own != theirs:
            self.odd.add(chunk)
        return own == theirs

    def encode(self, texts: list[str]) -> list[list[int]]:
        get, found, gaps, missing = self.known.get, [], [], set()
        for n, text in enumerate(texts):
            cut = self.chunks(text)
            values = list(map(get, cut))
            try:
                found.append(b"".join(values))
            except TypeError:  # some chunk is new
                holes = [i for i, x in enumerate(values) if x is None]
                gaps.append((n, cut, values, holes))
                missing.update([cut[i] for i in holes])
                found.append(b"")
        self.learn(missing)
        for n, cut, values, holes in gaps:
            for i in holes:
                values[i] = get(cut[i])
            found[n] = b"".join(values)
        ids = [memoryview(x).cast("H").tolist() for x in found]
        if self.odd:
            for n, text in enumerate(texts):
                if not self.odd.isdisjoint(self.chunks(text)):
                    ids[n] = self.library.encode(text)
        self.forget(missing)
        return ids

    def forget(self, missing: set[str]) -> None:
        """Drops a batch's long chunks, and everything once too much is held."""
        if self.held > LIMIT:
            self.known.clear()
            self.last.clear()
            self.odd.clear()
            self.held = 0
            return
        for chunk in missing:
            if len(chunk) > LONG:
                self.known.pop(chunk, None)
                self.odd.discard(chunk)

    def spelled(self, ids: list[int]) -> bytes:
        """The ids' decimals joined by commas."""
        return b",".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, model: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for each row.

    Null and empty texts have no ids and decode to the empty text. Repeated rows keep a row each; other columns are ignored;
    an empty table gives an empty result. Texts are taken whole, a few hundred at a time."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * with_ids
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for rows in row_slices(batches):
            columns = [[] for _ in names]
            for doc, ids in zip(rows.column(0).to_pylist(), own.encode([x or "" for x in rows.column(1).to_pylist()]), strict=True):
                decoded = own.decode(ids)
                row = [doc, len(ids), hashlib.sha256(own.spelled(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([ids, decoded] if with_ids else [])]
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema)
