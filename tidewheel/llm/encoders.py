"""Public tokenizers inside tasks: one instance per worker, whole texts, bounded caches."""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 600_000

# Characters whose lower case, normal form and class (letter, digit, sign, space) are beyond
# doubt: printable ASCII, the Latin-1 letters and ASCII white space.
_PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ\\n\\t\\r]*")
_UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \\n\\t\\ra-z0-9ß-öø-ÿ]+")
_ODD = "\0"


def file_digest(path: str) -> str:
    """Identifies a tokenizer by its file's bytes."""
    with open(path, "rb") as source:
        return hashlib.file_digest(source, "sha256").hexdigest()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a ``.json`` tokenizer that splits at white space before it merges.

    Such a tokenizer lower-cases a text and treats its runs of letters, its digits and its
    runs of signs independently, so the ids of a text are those of its units in a row; each
    distinct unit is encoded once and remembered: by the library's merge model alone, which
    takes a unit with its bytes written as the file's byte alphabet has them.  Units are cut here only from texts of
    plain characters.  Other texts are cut at blanks and line breaks: a part of plain
    characters gives units, any other part goes to the library whole, and so does a text
    that holds the string of an added token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.model = self.library.model
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.written = {c: bytewise(chr(c))[0][0] for c in range(0xC0, 0x100) if _PLAIN.fullmatch(chr(c))}

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn_units(self, units: list[str]) -> None:
        tokenize, flat, ends = self.model.tokenize, [], []
        for unit in units:
            written = unit if unit.isascii() else unit.translate(self.written)
            flat += [t.id for t in tokenize(written)]
            ends.append(len(flat))
        raw, width = np.array(flat, self.dtype).tobytes(), self.dtype.itemsize
        at = 0
        for unit, end in zip(units, ends):
            self.units[unit] = raw[at * width : end * width]
            at = end

    def _known(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units; new ones are learnt, one of an older half of the cache kept."""
        if len(self.units) > CACHE_ENTRIES // 2:
            self.older, self.units = self.units, {}
        missing = [u for u in units if u not in self.units]
        again = [u for u in missing if u in self.older]
        self.units.update((u, self.older[u]) for u in again)
        missing = [u for u in missing if u not in self.units]
        odd = [u for u in missing if u[:1] == _ODD]
        self._learn_units([u for u in missing if u[:1] != _ODD])
        self.units.update(zip(odd, self._raw([u[1:] for u in odd])))
        return [self.units[u] for u in units]

    def _cut(self, text: str) -> list[str]:
        units: list[str] = []
        for part in text.replace("\n", " ").split(" "):
            if _PLAIN.fullmatch(part):
                units += _UNITS.findall(part.lower())
            else:
                units.append(_ODD + part)
        return units

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Texts of plain characters, cut and numbered as Arrow columns: each distinct unit of
        the batch is looked up once, and its ids are copied to all its places by numpy."""
        low = pc.utf8_lower(pa.array(texts, pa.large_string()))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _UNITS.pattern, "\\0 "))
        numbered = lists.flatten().dictionary_encode()
        raws = self._known(numbered.dictionary.to_pylist())
        index = numbered.indices.to_numpy()
        width = self.dtype.itemsize
        sizes = np.array([len(r) // width for r in raws], np.int64)
        pool = np.frombuffer(b"".join(raws), self.dtype)
        starts = np.cumsum(sizes) - sizes
        many = sizes[index]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = pool[np.repeat(starts[index] - ends[:-1], many) + np.arange(ends[-1])].tobytes()
        bounds = (ends[np.asarray(lists.offsets)] * width).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def _other_ids(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self._raw([text])[0]
        units = self._cut(text)
        distinct = list(dict.fromkeys(units))
        return b"".join(map(dict(zip(distinct, self._known(distinct))).__getitem__, units))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``."""
        plain = [bool(_PLAIN.fullmatch(t)) and not any(a in t for a in self.added) for t in texts]
        found = iter(self._plain_ids([t for t, p in zip(texts, plain) if p]) if any(plain) else ())
        return [next(found) if p else self._other_ids(t) for t, p in zip(texts, plain)]


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.lru_cache(maxsize=4)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_counts(path: str, column: pa.Array) -> list[int]:
    """Tokens per text as the file's library counts them, without begin, end or special tokens."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    library = _library(path)
    if path.endswith(".model"):
        return [len(ids) for ids in library.encode(texts, num_threads=1)]
    return [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
