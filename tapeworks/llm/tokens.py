"""Whole-text encoders that remember the ids of recurring pieces.

A text is cut where the tokenizer cannot look across (the conditions stand at each class); each distinct piece is encoded
once by the library, and a text's ids are its pieces' ids in a row. A text that meets a case the cuts are not proven for
goes to the library whole. Pieces are kept per Python worker, up to about ``LIMIT`` bytes of them, then forgotten all at
once; pieces of over ``LONG`` characters hardly recur and are forgotten after their batch.
Ids are kept as little-endian unsigned 16-bit integers, so vocabularies of up to 65,536 ids are taken.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np

LIMIT, LONG = 192 << 20, 256
#: What Python needs for an entry besides its characters and ids.
ENTRY = 160


def ids_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2")


class Pieces:
    """Encodes lists of texts; subclasses say how to cut, and what pieces are sure and made of."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.known: dict[str, bytes] = {}
        self.unsure: set[str] = set()
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u2").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def in_a_row(self, tokenizer, pieces: list[str], glue: str, starts: Callable[[np.ndarray], np.ndarray]) -> list[bytes]:
        """The ids of many pieces, encoded together; ``starts`` finds where pieces begin in a row of ids."""
        rows = [glue.join(pieces[i : i + 4096]) for i in range(0, len(pieces), 4096)]
        found = []
        for x in tokenizer.encode_batch_fast(rows, add_special_tokens=False):
            ids = np.array(x.ids, "<u2")
            packed, cuts = ids.tobytes(), (2 * np.append(starts(ids), len(ids))).tolist()
            found += [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return found

    def cut(self, text: str) -> list[str] | None:
        """The text's pieces, or None if it must be encoded whole."""
        raise NotImplementedError

    def sure(self, piece: str) -> bool:
        """Whether a piece may be encoded on its own."""
        raise NotImplementedError

    def once(self, pieces: list[str]) -> list[bytes]:
        """The ids of new pieces."""
        raise NotImplementedError

    def parts(self, piece: str) -> list[str] | None:
        """The smaller pieces that a piece is made of, if any."""
        return None

    def learn(self, missing: set[str]) -> None:
        made, todo = {}, set()
        for piece in missing:
            if not self.sure(piece):
                self.unsure.add(piece)
            elif inner := self.parts(piece):
                made[piece] = inner
                todo.update(p for p in inner if p not in self.known)
            else:
                todo.add(piece)
        order = list(todo)
        self.known.update(zip(order, self.once(order), strict=True))
        for piece, inner in made.items():
            self.known[piece] = b"".join([self.known[p] for p in inner])
        self.held += sum([ENTRY + 4 * len(p) for p in missing]) + sum([ENTRY + 4 * len(p) for p in order])

    def forget(self, missing: set[str]) -> None:
        """Drops a batch's long pieces, and everything once too much is held."""
        if self.held > LIMIT:
            self.known.clear()
            self.unsure.clear()
            self.held = 0
            return
        for piece in missing:
            if len(piece) > LONG:
                self.known.pop(piece, None)
                self.unsure.discard(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        get, found, gaps, missing = self.known.get, [], [], set()
        for n, text in enumerate(texts):
            cut = self.cut(text)
            if cut is None:
                found.append(None)
                continue
            ids = list(map(get, cut))
            try:
                found.append(b"".join(ids))
            except TypeError:  # some piece is new or unsure
                holes = [i for i, x in enumerate(ids) if x is None]
                gaps.append((n, cut, ids, holes))
                missing.update([cut[i] for i in holes])
                found.append(None)
        self.learn(missing - self.unsure)
        for n, cut, ids, holes in gaps:
            for i in holes:
                ids[i] = get(cut[i])
            if all([ids[i] is not None for i in holes]):
                found[n] = b"".join(ids)
        self.forget(missing)
        rest = [n for n, ids in enumerate(found) if ids is None]
        for n, ids in zip(rest, self.whole([texts[n] for n in rest]), strict=True):
            found[n] = ids
        return found


class ByteLevel(Pieces):
    """The byte-level vocabulary whose pattern takes one leading space into a word.

    Cut before each single space, and before each single line feed, between two characters that are not white space: the
    token before cannot take it; a space begins the next token, a line feed is a token. A piece is kept without its
    space, with its line feed, and the text's first one after a carriage return (no sure piece begins so otherwise). A final
    comma or full stop after a letter is a token of its own. Pieces with the special token's first characters, with
    white space at an end, and empty ones are unsure."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that start with the space or the line feed
        self.opens[[i for token, i in vocabulary.items() if token[0] in "ĠĊ"]] = True

    def cut(self, text: str) -> list[str] | None:
        pieces = text.replace("\n", " \n").split(" ") if text else []
        pieces[:1] = ["\r" + p for p in pieces[:1]]
        return pieces

    def sure(self, piece: str) -> bool:
        rest = piece[1:] if piece[:1] in ("\r", "\n") else piece
        return bool(rest) and not rest[0].isspace() and not rest[-1].isspace() and "<|" not in rest

    def parts(self, piece: str) -> list[str] | None:
        if len(piece) > 2 and piece[-1] in ",." and piece[-2].isalpha() and piece[-2] < "ɐ":
            return [piece[:-1], "\r" + piece[-1]]
        return None

    def once(self, pieces: list[str]) -> list[bytes]:
        """Pieces with a space or line feed in front are encoded in a row: a token that starts with either starts one."""
        bare = [p for p in pieces if p[0] == "\r"]
        ids = dict(zip(bare, self.whole([p[1:] for p in bare]), strict=True))
        rest = [p for p in pieces if p[0] != "\r"]
        spelled = [p if p[0] == "\n" else " " + p for p in rest]
        ids.update(zip(rest, self.in_a_row(self.library, spelled, "", lambda row: np.flatnonzero(self.opens[row])), strict=True))
        return [ids[p] for p in pieces]


class WordLevel(Pieces):
    """The lower-casing vocabulary that drops white space: cut at white space; a final comma or full stop after a letter is
    a token of its own. Only for texts of characters below U+0250 (no combining marks, no case that depends on context)
    without the separators 1C to 1F; pieces with the special tokens' first characters are unsure."""

    odd = re.compile("[\x1c-\x1fɐ-\U0010ffff]")

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        # for pieces of letters alone: lower-cased and composed already, and one word each
        form = json.loads(self.library.to_str())
        byte_level = form["pre_tokenizer"]["pretokenizers"][-1]
        form |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
        self.letters = Tokenizer.from_str(json.dumps(form))
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith(form["model"]["end_of_word_suffix"])]] = True

    def cut(self, text: str) -> list[str] | None:
        if not text.isascii():
            try:
                text.encode("latin-1")  # much faster than the pattern
            except UnicodeEncodeError:
                if self.odd.search(text):
                    return None
        if any(x in text for x in "\x1c\x1d\x1e\x1f"):
            return None
        return text.lower().split()

    def sure(self, piece: str) -> bool:
        return "<|" not in piece

    def parts(self, piece: str) -> list[str] | None:
        if len(piece) > 1 and piece[-1] in ",." and piece[-2].isalpha():
            return [piece[:-1], piece[-1]]
        return None

    def once(self, pieces: list[str]) -> list[bytes]:
        """Pieces of letters are encoded in a row: a token with the end-of-word mark ends one."""
        mixed = [p for p in pieces if not p.isalpha()]
        ids = dict(zip(mixed, self.whole(mixed), strict=True))
        words = [p for p in pieces if p.isalpha()]
        after = lambda row: np.concatenate(([0], np.flatnonzero(self.closes[row])[:-1] + 1))
        ids.update(zip(words, self.in_a_row(self.letters, words, " ", after), strict=True))
        return [ids[p] for p in pieces]


@cache
def encoder(kind: type, path: str) -> Pieces:
    """One encoder for each worker process; Spark reuses workers, so pieces stay known between tasks."""
    return kind(path)
