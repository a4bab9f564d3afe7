"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE file becomes a deterministic transducer over characters. Its
transitions carry emitted-token counts: how many tokens the text read so far
has more (or fewer) than before the character, as if the text ended there.
Summed along a path they give the token count, so nothing is encoded.

A state joins the state of the pre-token pattern (run of letters, numbers,
other signs or white space, or a contraction under way) with that of the merges
inside the pre-token. The merge state lists the places where a vocabulary entry
that reaches the present byte may have begun, each with the last token before it
and the count there. By the pairwise test of byte-pair merging, exactly one
entry that ends at a byte is the last token of the text up to it. The states
are compiled when first met, into a table of bounded size.

A chunk's state map is constant behind its first synchronising place, a pre-token
border whatever came before: every entry state goes over into the same state
there. So a map is the characters up to that place, the count up to the last such
place, and the characters behind it, which name the exit state. Maps compose
associatively. Texts beyond one chunk are cut into rows, their chunks spread over
all tasks, and the maps reduced in two levels of a prefix scan.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from horizonkit.llm.byte_bpe import byte_symbols
from horizonkit.llm.common import keyed_text

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
CHUNK_CHARS = 32_768
#: Chunks composed by one task of the scan's first level.
FAN_IN = 64
#: States kept before the table is compiled anew, per Python worker.
MAX_STATES = 300_000
MAX_PAIRS = 1_000_000

LETTER, NUMBER, OTHER, SPACE = "letter", "number", "other", "space"
BORDER, QUOTE, HALF = "border", "quote", "half"
#: The contractions of the pre-token pattern, without their quote.
SHORT_ENDS = ("s", "t", "m", "d")
LONG_ENDS = {"r": "e", "v": "e", "l": "l"}


class Merges:
    """Merge states within one pre-token.

    A state is a tuple of (vocabulary trie node, last token before it, count
    there less the count here), the earliest place first.
    """

    start = ((0, -1, 0),)

    def __init__(self, vocabulary: dict[str, int], merges: list):
        symbol = byte_symbols()
        self.children: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        self.inner = {0}
        nodes = 1
        ids = {}
        for token, i in vocabulary.items():
            node = 0
            for b in (spelt := bytes(symbol[c] for c in token)):
                after = self.children.get((node, b))
                if after is None:
                    after = self.children[node, b] = nodes
                    nodes += 1
                self.inner.add(node)
                node = after
            ids[spelt] = i
            self.token_at[node] = i
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            if made in self.parts:
                raise ValueError("a token with two merges has no single derivation")
            self.rank[pair] = k
            self.parts[made] = (k, *pair)
        self.pairs: dict[tuple[int, int], bool] = {}

    def adjacent(self, left: int, right: int) -> bool:
        """Can ``right`` follow ``left`` in an encoding: does no merge cross their border?

        Both are unmerged along the border and rebuilt in rank order. A merge of
        the two symbols at the border wins if it ranks before the next merge
        that uses one of them; of equal ranks the leftmost place is merged first.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        spine_l, spine_r = [(left, 0)], [(right, 0)]
        while (made := self.parts.get(spine_l[-1][0])) is not None:
            spine_l[-1] = (spine_l[-1][0], made[0])
            spine_l.append((made[2], 0))
        while (made := self.parts.get(spine_r[-1][0])) is not None:
            spine_r[-1] = (spine_r[-1][0], made[0])
            spine_r.append((made[1], 0))
        never = len(self.rank)
        i, j, valid = len(spine_l) - 1, len(spine_r) - 1, True
        while True:
            next_l = spine_l[i - 1][1] if i else never
            next_r = spine_r[j - 1][1] if j else never
            across = self.rank.get((spine_l[i][0], spine_r[j][0]), never)
            if across < next_l and across <= next_r and across != never:
                valid = False
                break
            if not i and not j:
                break
            if next_l <= next_r:
                i -= 1
            else:
                j -= 1
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = valid
        return valid

    def read(self, live: tuple, text: str) -> tuple[tuple, int]:
        """The merge state behind ``text`` and the change of the count."""
        total = 0
        for byte in text.encode():
            moved, last, more = [], None, 0
            for node, before, back in live:  # longest first
                after = self.children.get((node, byte))
                if after is None:
                    continue
                if last is None and (token := self.token_at.get(after)) is not None:
                    if before < 0 or self.adjacent(before, token):
                        last, more = token, back + 1
                if after in self.inner:
                    moved.append((after, before, back))
            live = (*((node, before, back - more) for node, before, back in moved), (0, last, 0))
            total += more
        return live, total


class State(dict):
    """Transitions ``character -> (state, emitted tokens)`` of one compiled state, filled when first met."""

    __slots__ = ("machine", "mode", "merge", "shorter", "held", "last")

    def __init__(self, machine: Transducer, mode: str, merge=None, shorter=None, held: int = 0, last: str = ""):
        self.machine, self.mode, self.merge = machine, mode, merge
        #: for white space: the merge state without its last character, the count that one adds, and that character
        self.shorter, self.held, self.last = shorter, held, last

    def __missing__(self, char: str) -> tuple[State, int]:
        step = self[char] = self.machine.step(self, char)
        return step


class Transducer:
    """``count(text)`` equals the number of ids the tokenizers library gives, special strings included."""

    _made: dict[str, Transducer] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError(f"{path} is no byte-level BPE file without a normalizer and prefix space")
        added = spec.get("added_tokens", [])
        if any(t[flag] for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = [t["content"] for t in added]
        self.found_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        #: a place this far from a text's ends shows every special string over it
        self.margin = max(map(len, self.special), default=1)
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.pattern = ByteLevel(add_prefix_space=False, use_regex=True)
        self.classes: dict[str, str] = {}
        self._clear()

    @classmethod
    def shared(cls, path: str) -> Transducer:
        """One transducer per Python worker and vocabulary file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.border = self.state(BORDER)

    def state(self, mode: str, merge=None, shorter=None, held: int = 0, last: str = "") -> State:
        key = (mode, merge, shorter, held, last)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, *key)
        return found

    def kind(self, char: str) -> str:
        """The pattern's class of a character, as the library itself splits it off."""
        known = self.classes.get(char)
        if known is None:
            known = SPACE
            for probe, name in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                if len(self.pattern.pre_tokenize_str(probe + char)) == 1:
                    known = name
            self.classes[char] = known
        return known

    def step(self, state: State, char: str) -> tuple[State, int]:
        """The next state and the change of the count, as if the text ended behind ``char``."""
        if len(self.states) >= MAX_STATES:
            self._clear()  # states under way keep what they refer to
        kind, mode, read = self.kind(char), state.mode, self.merges.read
        if mode == HALF:  # a quote and one letter; the letter counts as a run of its own
            if char == LONG_ENDS[state.last]:
                whole, quote = read(self.merges.start, "'" + state.last + char)[1], read(self.merges.start, "'")[1]
                return self.border, whole - quote - read(self.merges.start, state.last)[1]
            mode = LETTER
        if mode == QUOTE:
            if char in SHORT_ENDS:
                return self.border, read(self.merges.start, "'" + char)[1] - read(self.merges.start, "'")[1]
            if char in LONG_ENDS:
                merge, more = read(self.merges.start, char)
                return self.state(HALF, merge, last=char), more
            mode = OTHER
        if mode == SPACE:
            if kind == SPACE:
                merge, more = read(state.merge, char)
                return self.state(SPACE, merge, state.merge, more, char), more
            if state.last == " ":  # the last space goes to the run that begins
                merge, more = read(self.merges.start, " " + char)
                return self.state(kind, merge), more - state.held
            alone = read(self.merges.start, state.last)[1]
            after, more = self.step(self.border, char)
            return after, alone + more - state.held
        if mode == kind:
            merge, more = read(state.merge, char)
            return self.state(kind, merge), more
        merge, more = read(self.merges.start, char)  # a new pre-token
        if kind == SPACE:
            return self.state(SPACE, merge, self.merges.start, more, char), more
        return self.state(QUOTE if char == "'" else kind, merge), more

    def count(self, text: str) -> int:
        total = 0
        for i, part in enumerate(self.found_special.split(text)):
            total += i > 0
            state = self.border
            for char in part:
                state, more = state[char]
                total += more
        return total

    def synchronises(self, before: str, after: str) -> bool:
        """Is there a pre-token border between the two characters, whatever surrounds them?"""
        left, right = self.kind(before), self.kind(after)
        return left != SPACE and left != right and not (before == "'" and right == LETTER)

    def chunk_map(self, text: str) -> StateMap:
        """The state map of a chunk.

        Only places far enough from the chunk's ends count, and none inside a special string.
        """
        inside = [(m.start(), m.end()) for m in self.found_special.finditer(text)]

        def first(places) -> int | None:
            for p in places:
                if self.synchronises(text[p - 1], text[p]) and not any(a < p < b for a, b in inside):
                    return p
            return None

        low, high = max(1, self.margin), len(text) - max(1, self.margin)
        begin = first(range(low, high + 1))
        if begin is None:
            return StateMap(text, None, "")
        end = first(range(high, begin - 1, -1))
        return StateMap(text[:begin], self.count(text[begin:end]), text[end:])


@dataclass(frozen=True)
class StateMap:
    """Reads ``head`` in any entry state, adds ``inner`` and leaves in the state that ``tail`` leads to.

    ``inner`` is None where the chunk never synchronises; then ``head`` is all of it.
    """

    head: str
    inner: int | None
    tail: str

    def then(self, after: StateMap, machine: Transducer) -> StateMap:
        """The map of both chunks, this one first."""
        if self.inner is None:
            return StateMap(self.head + after.head, after.inner, after.tail)
        if after.inner is None:
            return StateMap(self.head, self.inner, self.tail + after.head)
        return StateMap(self.head, self.inner + machine.count(self.tail + after.head) + after.inner, after.tail)

    def total(self, machine: Transducer) -> int:
        """The count of a whole text: the entry state is the border."""
        if self.inner is None:
            return machine.count(self.head)
        return machine.count(self.head) + self.inner + machine.count(self.tail)


COUNTED = "doc_id long, n_bytes long, n_tokens long"
MAPPED = "row long, at long, doc_id long, n_bytes long, head string, inner long, tail string"


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = TOKEN_LIMIT,
                 chunk_chars: int = CHUNK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs``.

    A null text counts as the empty one, which has no tokens. Repeated rows and
    null ids are rows of their own; other columns are ignored; an empty table
    gives no rows. A text of at most ``chunk_chars`` is read where it lies. The
    chunks of longer ones are dealt over all tasks, and only their maps come
    together: the text with its one row number, first 64 chunks at a time.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = keyed_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def whole(batches):
        machine = Transducer.shared(path)
        for batch in batches:
            counts = [machine.count(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    short = rows.where(F.length("text") <= chunk_chars).select("doc_id", "n_bytes", "text").mapInArrow(whole, COUNTED)

    names, kinds = ["row", "at", "doc_id", "n_bytes", "head", "inner", "tail"], [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string()]

    def to_maps(batches):
        machine = Transducer.shared(path)
        for batch in batches:
            made = [machine.chunk_map(text) for text in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([m.head for m in made], pa.string()),
                 pa.array([m.inner for m in made], pa.int64()), pa.array([m.tail for m in made], pa.string())], names=names
            )

    def composed(table: pa.Table) -> tuple[Transducer, list[dict], StateMap]:
        machine = Transducer.shared(path)
        chunks = table.sort_by("at").to_pylist()
        maps = [StateMap(c["head"], c["inner"], c["tail"]) for c in chunks]
        while len(maps) > 1:  # neighbours, level by level
            maps = [maps[i].then(maps[i + 1], machine) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return machine, chunks, maps[0]

    def block(table: pa.Table) -> pa.Table:
        _, chunks, m = composed(table)
        return pa.Table.from_batches([_batch(
            [(chunks[0]["row"], chunks[0]["at"] // FAN_IN, chunks[0]["doc_id"], chunks[0]["n_bytes"], m.head, m.inner, m.tail)],
            kinds, names)])

    def finish(table: pa.Table) -> pa.Table:
        machine, chunks, m = composed(table)
        return pa.Table.from_batches([_batch(
            [(chunks[0]["doc_id"], chunks[0]["n_bytes"], m.total(machine))], [pa.int64()] * 3, ["doc_id", "n_bytes", "n_tokens"])])

    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    chunks = (
        rows.withColumn("row", F.monotonically_increasing_id()).where(F.length("text") > chunk_chars)
        .select("row", "doc_id", "n_bytes", F.posexplode(cut).alias("at", "chunk"))
        .select("row", F.col("at").cast("long").alias("at"), "doc_id", "n_bytes", "chunk").repartition("row", "at")
    )
    blocks = chunks.mapInArrow(to_maps, MAPPED).groupBy("row", F.floor(F.col("at") / FAN_IN)).applyInArrow(block, MAPPED)
    counted = short.unionByName(blocks.groupBy("row").applyInArrow(finish, COUNTED))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
