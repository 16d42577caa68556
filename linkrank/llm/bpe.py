"""Byte-pair encoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never end up in one token, whatever
the merges do, so a cut between the two is certain. A word is cut at every such pair, the fragments are merged
independently of each other, and their ids are concatenated. Since merges are local to a fragment, the result is the
one of the whole word. Fragments and words recur, so both are kept in bounded caches.

Normalisation (NFC, white space, lower case) is the vocabulary file's own; special tokens written out in a text are
recognised before it, as the file asks.

Results for odd input: null and empty texts have no tokens; a text of white space has none either. Nothing is cut off,
however long a text or a single word is.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

from linkrank.llm.common import map_arrow

WORD_END = "</w>"
#: Entries that a worker's cache of fragments may hold; those of chunks and words hold as many recent ones, and as many older.
CACHE_ENTRIES = 120_000
#: The same for caches of numbers, whose entries are small.
CACHE_COUNTS = 400_000
#: Longer words are encoded without being kept.
CACHE_WORD_CHARS = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class RecentCache:
    """Entries at hand (``now``). Once there are more than ``most``, they become the older ones, which are kept until the next such turn unless used."""

    def __init__(self, most: int):
        self.most, self.now, self.older = most, {}, {}

    def turn(self) -> None:
        """Make room, between batches."""
        if len(self.now) > self.most:
            self.now, self.older = {}, self.now

    def missing(self, keys: set[str]) -> set[str]:
        """The keys without an entry; entries of all others are at hand until the next turn."""
        older = self.older
        absent = keys.difference(self.now)
        new = absent.difference(older)
        self.now.update([(k, older[k]) for k in absent.difference(new)])
        return new


class ForcedBoundaryEncoder:
    """Encodes texts with a byte-level BPE file whose words end in ``</w>``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError(f"{path} is no BPE vocabulary with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        steps = [x["type"] for x in spec["normalizer"].get("normalizers", [spec["normalizer"]])]
        self.lowers = steps in (["NFC", "Replace", "Lowercase"], ["Lowercase"])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")).findall
        before, _, _ = split["pattern"]["Regex"].partition(r"|[\p{L}]+|")
        self.letters_are_words = before != split["pattern"]["Regex"] and all(x.startswith("'") for x in before.split("|"))
        by_length = sorted(self.specials, key=len, reverse=True)
        self.cut_specials = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")").split if by_length else None
        self.special_mark = by_length[0][:2] if by_length else ""
        self.inside = self._pairs_inside_tokens()
        self.inside_bytes = self._as_bytes(self.inside)
        self.bulk = Tokenizer(models.BPE(vocab=self.vocab, merges=list(self.ranks), end_of_word_suffix=WORD_END, cache_capacity=0))
        self.bulk.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        top = max(self.tokens) + 1
        self.id_text, self.id_token = [str(i) for i in range(top)], [self.tokens.get(i, "") for i in range(top)]
        self.id_names, self.token_names = pa.array(self.id_text), pa.array(self.id_token)
        self.chunk_cache = RecentCache(CACHE_ENTRIES)
        self.ends_word = np.array([t.endswith(WORD_END) for t in self.id_token])
        self.void = False  # whether a chunk without tokens was seen
        self.chunk_counts: dict[str, int] = {}
        self.word_counts: dict[str, int] = {}
        self.fragment_cache: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.word_cache = RecentCache(CACHE_ENTRIES)

    def _pairs_inside_tokens(self) -> set[str]:
        inside: set[str] = set()
        for token in self.vocab:
            body = token.removesuffix(WORD_END)
            inside.update(body[i : i + 2] for i in range(len(body) - 1))
        return inside

    def _as_bytes(self, pairs: set[str]) -> np.ndarray:
        """inside[256 * first + second] of a pair of bytes."""
        byte = {letter: b for b, letter in enumerate(self.letters)}
        inside = np.zeros(65536, bool)
        inside[[byte[a] * 256 + byte[b] for a, b in pairs if a in byte and b in byte]] = True
        return inside

    def fragments(self, word: str) -> list[str]:
        """The word in byte letters, cut at every pair that is inside no token."""
        if word.isascii():
            symbols = word if not (set(word) - self._printable) else "".join(self.letters[b] for b in word.encode())
        else:
            symbols = "".join([self.letters[b] for b in word.encode()])
        inside, start, out = self.inside, 0, []
        for i in range(1, len(symbols)):
            if symbols[i - 1 : i + 1] not in inside:
                out.append(symbols[start:i])
                start = i
        out.append(symbols[start:])
        return out

    _printable = frozenset(map(chr, range(0x21, 0x7F)))

    def _merge(self, fragment: str, ends_word: bool) -> tuple[int, ...]:
        """Ids of one fragment: the pair of lowest rank, leftmost first, is merged until none is left."""
        parts = list(fragment)
        if ends_word:
            parts[-1] += WORD_END
        if len(parts) > 1:
            whole = self.vocab.get("".join(parts)) if len(parts) == 2 else None
            if whole is not None and tuple(parts) in self.ranks:
                return (whole,)
            parts = self._merge_long(parts) if len(parts) > 48 else self._merge_short(parts)
        return tuple([self.vocab[p] for p in parts])

    def _merge_short(self, parts: list[str]) -> list[str]:
        get, never = self.ranks.get, len(self.ranks)
        ranks = [get(p, never) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), never)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap and linked neighbours, for fragments of any length."""
        get, n = self.ranks.get, len(parts)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = left + right, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p, keep in zip(parts, alive) if keep]

    def word_ids(self, word: str) -> list[int]:
        ids: list[int] = []
        pieces = self.fragments(word)
        for k, piece in enumerate(pieces):
            key = (piece, k == len(pieces) - 1)
            got = self.fragment_cache.get(key)
            if got is None:
                got = self._merge(*key)
                if len(piece) <= CACHE_WORD_CHARS:
                    if len(self.fragment_cache) >= CACHE_ENTRIES:
                        self.fragment_cache.clear()
                    self.fragment_cache[key] = got
            ids.extend(got)
        return ids

    def chunks(self, text: str | None) -> list[str]:
        """The text cut at white space, which is in no token either. (Python also cuts at four control characters.)"""
        if not text:
            return []
        return text.split() if self._controls(text) is None else [c for c in self._white_space(text) if c]

    _controls = re.compile("[\x1c-\x1f]").search
    _white_space = regex.compile(r"\p{White_Space}+").split

    def _words_of(self, chunk: str) -> list[str]:
        """The words of a chunk, normalised; a special token written out is a word of its own."""
        if self.special_mark and self.special_mark in chunk:
            return [w for part in self.cut_specials(chunk) if part for w in ([part] if part in self.specials else self.words(self.normalize(part)))]
        return self.words(self.normalize(chunk))

    def _without_cuts(self, words: list[str]) -> list[str]:
        """The words without a certain cut inside, which go through the merges in bulk. A space is in no token, so it parts words."""
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        cut = ~self.inside_bytes[data[:-1].astype(np.intp) * 256 + data[1:]]
        spaces = data == 32
        cut &= ~(spaces[:-1] | spaces[1:])
        of = np.cumsum(spaces)
        in_parts = set(of[:-1][cut].tolist())
        return [w for i, w in enumerate(words) if i not in in_parts and len(w) <= CACHE_WORD_CHARS and w not in self.specials]

    def _in_bulk(self, whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each word has: its last token, and no other, ends a word."""
        ids = np.array(self.bulk.encode_batch_fast([" ".join(whole)], add_special_tokens=False)[0].ids, np.int64)
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def _learn_words(self, words: list[str]) -> None:
        """Fill the word cache: words without a certain cut in bulk, others fragment by fragment."""
        whole = self._without_cuts(words)
        if whole:
            ids, n = self._in_bulk(whole)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            joined = [pc.binary_join(pa.ListArray.from_arrays(ends, names.take(pa.array(ids))), " ").to_pylist() for names in (self.id_names, self.token_names)]
            self.word_cache.now.update(zip(whole, zip(*joined, n.tolist()), strict=True))
        known = self.word_cache.now
        for word in words:
            if word not in known:
                ids = [self.specials[word]] if word in self.specials else self.word_ids(word)
                known[word] = (" ".join([self.id_text[i] for i in ids]), " ".join([self.id_token[i] for i in ids]), len(ids))

    def _words_by_chunk(self, chunks: set[str]) -> dict[str, list[str]]:
        plain = [c for c in chunks if not (self.special_mark and self.special_mark in c)]
        # to lower case is all that the rules do to ASCII, in which a chunk has no white space
        ascii_ = [c for c in plain if c.isascii()] if self.lowers else []
        other = [c for c in plain if not c.isascii()] if ascii_ else plain
        out = {c: self._words_of(c) for c in chunks.difference(plain)}
        words, whole = self.words, self.letters_are_words
        for some, normalize in ((ascii_, str.lower), (other, self.normalize)):
            if some:
                normal = normalize(" ".join(some)).split(" ")
                # letters up to this one are the same in every version of Unicode
                out.update([(c, [n] if whole and n.isalpha() and (n.isascii() or max(n) < "\u0250") else words(n)) for c, n in zip(some, normal, strict=True)])
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text; as :meth:`batch`, without the tokens."""
        if len(self.chunk_counts) > CACHE_COUNTS:
            self.chunk_counts.clear()
        if len(self.word_counts) > CACHE_COUNTS:
            self.word_counts.clear()
        cache, known = self.chunk_counts, self.word_counts
        split = [self.chunks(t) for t in texts]
        missing = {c for chunks in split for c in chunks if c not in cache}
        if missing:
            words = self._words_by_chunk(missing)
            fresh = list({w for ws in words.values() for w in ws}.difference(known))
            if fresh:
                if whole := self._without_cuts(fresh):
                    known.update(zip(whole, self._in_bulk(whole)[1].tolist(), strict=True))
                for w in fresh:
                    if w not in known:
                        known[w] = 1 if w in self.specials else len(self.word_ids(w))
            for chunk, ws in words.items():
                cache[chunk] = known[ws[0]] if len(ws) == 1 else sum([known[w] for w in ws])
        get = cache.__getitem__
        return [sum(map(get, chunks)) for chunks in split]

    def batch(self, texts: list[str | None]) -> list[list[tuple[str, str, int]]]:
        """For each text, (ids in decimal, decoded tokens, number of tokens) of each of its chunks."""
        self.chunk_cache.turn()
        self.word_cache.turn()
        cache, known = self.chunk_cache.now, self.word_cache.now
        split = [self.chunks(t) for t in texts]
        missing = self.chunk_cache.missing(set(chain.from_iterable(split)))
        if missing:
            words = self._words_by_chunk(missing)
            if fresh := self.word_cache.missing(set(chain.from_iterable(words.values()))):
                self._learn_words(list(fresh))
            for chunk, ws in words.items():
                if len(ws) == 1:
                    cache[chunk] = known[ws[0]]
                elif len(ws) == 2:
                    (i, t, n), (j, u, m) = known[ws[0]], known[ws[1]]
                    cache[chunk] = (f"{i} {j}", f"{t} {u}", n + m)
                else:
                    got = [known[w] for w in ws]
                    cache[chunk] = (" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got]))
                    self.void |= not ws
        get = cache.__getitem__
        found = [list(map(get, chunks)) for chunks in split]
        return [[g for g in got if g[2]] for got in found] if self.void else found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.batch([text])[0] for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of the decoded text, for each text."""
        sha, (ids, tokens, n) = hashlib.sha256, map(itemgetter, range(3))
        return [(sum(map(n, got)), sha(" ".join(map(ids, got)).encode()).hexdigest(), sha(" ".join(map(tokens, got)).encode()).hexdigest()) for got in self.batch(texts)]


_encoders: dict[str, ForcedBoundaryEncoder] = {}


def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder for each file in a worker process, which tasks reuse with its caches."""
    if path not in _encoders:
        _encoders[path] = ForcedBoundaryEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids and the decoded text of every row: (key, tokens array<int>, decoded string)."""

    def build():
        enc = encoder(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = enc.batch(batch.column(1).to_pylist())
            ids = [[int(i) for g in pieces for i in g[0].split(" ")] for pieces in got]
            decoded = [" ".join([g[1] for g in pieces]) for pieces in got]
            return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "tokens", "decoded"])

        return apply

    return map_arrow(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), build, "doc_id long, tokens array<int>, decoded string", rows=200)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def build():
        enc = encoder(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = enc.digests(batch.column(1).to_pylist())
            n, ids, decoded = zip(*got) if got else ((), (), ())
            return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return apply

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), build, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=200)


def count_documents(docs: DataFrame, path: str) -> DataFrame:
    """(n_tokens) of every row."""

    def build():
        enc = encoder(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([pa.array(enc.counts(batch.column(0).to_pylist()), pa.int64())], ["n_tokens"])

        return apply

    return map_arrow(docs.select(docs["text"].alias("text")), build, "n_tokens long", rows=200)
