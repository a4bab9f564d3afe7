"""BPE encoding as a bounded-lookahead streaming transducer, and its decoder.

Merges apply in the order of the merge list, so a merge further right can only
reach back over a chain of overlapping rules with falling priority. The longest
such chain of the list bounds the lookahead: a token that ends at least that
many symbols before the end of what has been read stays, whatever follows.
Where a token ends no merge crosses, so the rest starts afresh. The transducer
holds one block and one lookahead of symbols at most.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from horizonkit.llm.byte_bpe import byte_symbols
from horizonkit.llm.common import keyed_text

TOKENIZER = "word_bpe_49k.json"
BLOCK = 4096
SHORT = 48
CACHE = 1_200_000


def sufficient_lookahead(merges: list[tuple[str, str]], longest: int | None = None) -> int:
    """Symbols after a token's end that settle it, for this merge list.

    A rule applied at one place can be pre-empted only by an earlier rule whose
    string overlaps its end. The reach of a rule is its own length plus the
    largest reach among earlier rules that start inside it; the bound is the
    largest reach of all.
    """
    reach_of_start: dict[str, int] = {}  # by proper prefix of earlier rules' strings
    bound = 1
    for left, right in merges:
        word = left + right
        reach = len(word) + max((reach_of_start.get(word[i:], 0) for i in range(1, len(word))), default=0)
        bound = max(bound, reach)
        for i in range(1, len(word)):
            if reach_of_start.get(word[:i], 0) < reach:
                reach_of_start[word[:i]] = reach
    return bound


class MergeTable:
    """Vocabulary and ranked merges of a BPE file with a word-end suffix or none."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.suffix: str = model["end_of_word_suffix"] or ""
        # the suffix counts as one symbol that belongs to the last character
        mark = "\0"
        self.lookahead = sufficient_lookahead(
            [(a.replace(self.suffix, mark), b.replace(self.suffix, mark)) for a, b in pairs]
            if self.suffix else pairs
        )

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges to a bounded buffer, lowest rank first, then leftmost."""
        rank, n = self.rank, len(symbols)
        if n <= SHORT:
            return self._merge_short(list(symbols))
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        parts: list[str | None] = list(symbols)
        heap = [(rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != pair[0] or parts[j] != pair[1]:
                continue  # a neighbour has been merged since
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (parts[a], parts[b])) in rank:
                    heapq.heappush(heap, (rank[p], a, p))
        return [p for p in parts if p is not None]


    def _merge_short(self, parts: list[str]) -> list[str]:
        get, none = self.rank.get, len(self.rank)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts


class StreamEncoder:
    """Transducer for one pre-token: ``feed`` characters, then ``finish``.

    Both return the tokens that have become final.
    """

    def __init__(self, table: MergeTable, block: int = BLOCK):
        self.table, self.block, self.held = table, block, []

    def feed(self, characters: str) -> list[str]:
        self.held.extend(characters)
        out: list[str] = []
        while len(self.held) >= self.block + self.table.lookahead:
            window = self.held[: self.block + self.table.lookahead]
            stable = len(window) - self.table.lookahead
            end = 0
            for token in self.table.merge(window):
                if end + len(token) > stable:
                    break
                end += len(token)
                out.append(token)
            if not end:
                raise ValueError("block is shorter than a token")
            del self.held[:end]
        return out

    def finish(self) -> list[str]:
        out: list[str] = []
        if self.held:
            self.held[-1] += self.table.suffix
            out = self.table.merge(self.held)
        self.held = []
        return out


class StreamDecoder:
    """State machine from ids to text.

    A file without a decoder writes token strings with a space between; with a
    byte-level decoder the bytes of a character may come from several tokens,
    and the decoder waits for the missing ones.
    """

    def __init__(self, table_strings: dict[int, str], byte_level: bool):
        self.strings, self.byte_level, self.started = table_strings, byte_level, False
        self.symbol = byte_symbols() if byte_level else {}
        self.bytes_to_text = codecs.getincrementaldecoder("utf-8")("replace") if byte_level else None

    def feed(self, token_id: int) -> str:
        token = self.strings.get(token_id)
        if token is None:
            return ""
        if self.byte_level:
            return self.bytes_to_text.decode(bytes(self.symbol[c] for c in token))
        gap, self.started = " " if self.started else "", True
        return gap + token

    def finish(self) -> str:
        return self.bytes_to_text.decode(b"", True) if self.byte_level else ""


class WordCodec:
    """Encodes white-space-separated parts of texts and remembers their ids.

    Normalising and pre-tokenizing are the library's own, per part; its
    patterns never cross ASCII white space. The cache empties when full.
    """

    _made: dict[str, WordCodec] = {}

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.table = MergeTable(path)
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.strings = {i: s for s, i in self.table.vocabulary.items()} | {i: t.content for i, t in added.items()}
        self.byte_level = self.library.decoder is not None
        self.encoder = StreamEncoder(self.table)
        self.tokens: dict[str, list[int]] = {}
        self.cache: dict[bytes, bytes] = {}
        self.texts: dict[bytes, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> WordCodec:
        """One codec per Python worker and vocabulary file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def token_ids(self, token: str) -> list[int]:
        """Ids of one pre-token, fed to the transducer in blocks."""
        found: list[str] = []
        for start in range(0, len(token), BLOCK):
            found += self.encoder.feed(token[start : start + BLOCK])
        found += self.encoder.finish()
        return [self.table.vocabulary[t] for t in found]

    def part_ids(self, part: str) -> list[int]:
        """Ids of a text without special tokens."""
        if part.isascii() and part.isalpha():  # one pre-token, and its bytes stand for themselves
            tokens = [part.lower()]
        else:
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
            tokens = [t for t, _ in pieces]
        out: list[int] = []
        for token in tokens:
            ids = self.tokens.get(token)
            if ids is None:
                ids = self.token_ids(token)
                if len(token) <= SHORT:
                    if len(self.tokens) >= CACHE // 3:
                        self.tokens.clear()
                    self.tokens[token] = ids
            out += ids
        return out

    def text_ids(self, text: str) -> list[int]:
        """Ids of a text that may hold special-token strings."""
        out: list[int] = []
        while text:
            at, name = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=(len(text), ""))
            out += self.part_ids(text[:at]) + ([self.special[name]] if name else [])
            text = text[at + len(name) :]
        return out

    def decode(self, ids: list[int]) -> str:
        decoder = StreamDecoder(self.strings, self.byte_level)
        return "".join([*map(decoder.feed, ids), decoder.finish()])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text.

        Ids and token strings of each part are kept with a space after each,
        so a text's are the parts' in a row.
        """
        if self.byte_level or any(s in text for s in self.special):
            ids = self.text_ids(text)
            joined = " ".join(map(str, ids)).encode()
            return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()
        data = text.encode()
        parts = (data.lower() if data.isascii() else data).split()  # the normaliser lower-cases too
        cache, texts = self.cache, self.texts
        if len(cache) > CACHE:
            cache.clear()
            texts.clear()
        for part in set(parts).difference(cache):
            ids = self.part_ids(part.decode())
            cache[part] = "".join(f"{i} " for i in ids).encode()
            texts[part] = (self.decode(ids) + " ").encode() if ids else b""
        joined = b"".join(map(cache.__getitem__, parts))
        decoded = b"".join(map(texts.__getitem__, parts))
        return joined.count(b" "), hashlib.sha256(joined[:-1]).hexdigest(), hashlib.sha256(decoded[:-1]).hexdigest()


def encode_digests(docs: DataFrame, tokenizer: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row.

    Null and empty texts have no ids; their digests are of the empty string.
    Repeated rows and null ids keep a row each.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def compute(batches):
        codec = WordCodec.shared(path)
        for batch in batches:
            rows = [codec.digest(t) for t in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(
        compute, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
