"""Chat formatting at the level of tokens.

A turn becomes: reserved id of its role, the ids of its text, the reserved end of turn.
Texts are encoded by themselves, so no merge crosses a segment, and the reserved ids are
spliced in as numbers: no text can produce them. The readable form of the reserved ids
is a set of control strings; where one occurs in a text, or a backslash, a backslash is
put before it, which reading back undoes. A role without an id of its own is written
after the id for other roles and closed by the one for a role's end.

The loss mask covers the texts of assistant turns: +1 is put where one starts and -1
after it ends, and the mask is where the prefix sum is positive.

Turns are encoded where they are read, and only their ids travel. Rows then meet by
conversation, sorted by turn, and pass through each task as a stream: a conversation of
any length is spliced in chunks of at most CHUNK ids, and none is ever held whole. One
conversation is one task's work, since its digest is one sequence.

The reserved ids are the first beyond the vocabulary that is given, whatever its size.

Edge cases: null texts are empty, null roles are the empty role. Null turns come first;
rows of one turn are ordered by their ids (which role and text alone decide), so
repeated rows all count. A null conv_id is one conversation. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, workers_see_package

#: What the reserved ids read as, in the order of the ids; the roles that have one.
READS = ("### System: ", "### User: ", "### Assistant: ", "### Role ", ": ", " </turn>\n")
ROLES = ("system", "user", "assistant")
OTHER_ROLE, ROLE_END, TURN_END = 3, 4, 5
LOSS_ROLE = "assistant"
#: What a text must not say as it stands.
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
CHUNK = 65_536
#: Runs of white space, as the encoder's pattern has it, that its backtracking is spared.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


class Codec:
    """Byte-level BPE of one vocabulary file (ranks or JSON); ``base`` is the first id beyond it."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._encode, self.bytes_of = lambda text: _encode_long(own, text), own.decode_bytes
            self.base = max(ranks.values()) + 1
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True  # their names in a text are ordinary text
            back = {c: b for b, c in _byte_letters().items()}
            pieces = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in own.get_vocab(True).items()}
            self._encode = lambda text: own.encode(text, add_special_tokens=False).ids
            self.bytes_of = lambda ids: b"".join(map(pieces.__getitem__, ids))
            self.base = max(pieces) + 1
        self.roles = {role: self.base + k for k, role in enumerate(ROLES)}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids.tolist()).decode("utf-8", "replace")

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int]:
        """(ids of the turn, where its text starts in them)."""
        head = [self.roles[role]] if role in self.roles else [self.base + OTHER_ROLE, *self._encode(escape(role)), self.base + ROLE_END]
        return np.concatenate([np.array(head, np.int32), self.encode(escape(text)), np.array([self.base + TURN_END], np.int32)]), len(head)


def _encode_long(own, text: str) -> list[int]:
    """encode_ordinary, with long white space cut out as the pattern would cut it: all of a run but its last character, which goes to what follows, is one piece."""
    out, at = [], 0
    for run in _LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += own.encode_ordinary(text[at : run.start()])
        out += own._encode_single_piece(text[run.start() : end])
        at = end
    return out + own.encode_ordinary(text[at:])


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_turns(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, turn, role, text as bytes) -> conv_id, turn, ids (of the turn, reserved ones included), start (of its text in them), loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, ids, start, loss = batch.slice(at, 512), [], [], []
                for role, text in zip(part.column("role"), part.column("text")):
                    role = role.as_py().decode("utf-8", "replace")
                    turn, begins = own.turn(role, text.as_py().decode("utf-8", "replace"))
                    ids.append(turn.astype("<i4").tobytes())
                    start.append(begins)
                    loss.append(role == LOSS_ROLE)
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), pa.array(ids, pa.binary()), pa.array(start, pa.int32()), pa.array(loss, pa.bool_())], ["conv_id", "turn", "ids", "start", "loss"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids binary, start int, loss boolean")


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, chunk, input_ids (array<int>), loss_mask (array<boolean>): the chunks of a conversation in order, cut between turns where they can be."""
    workers_see_package(conversations.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = conversations.select(F.col("conv_id"), F.col("turn"), as_bytes(F.col("role")).alias("role"), as_bytes(F.col("text")).alias("text"))
    turns = encode_turns(rows, path).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "ids").select("conv_id", "ids", "start", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, held, size = None, 0, [], 0

        def flush():
            nonlocal chunk, size
            ids = np.concatenate([h[0] for h in held])
            delta = np.zeros(len(ids) + 1, np.int32)
            at = 0
            for part, a, b in held:  # a..b: where the loss covers this part
                delta[at + a] += 1
                delta[at + b] -= 1
                at += len(part)
            mask = np.cumsum(delta)[:-1] > 0
            held.clear()
            size = 0
            chunk += 1
            end = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([chunk - 1], pa.int64()), pa.ListArray.from_arrays(end, pa.array(ids)), pa.ListArray.from_arrays(end, pa.array(mask))], ["conv_id", "chunk", "input_ids", "loss_mask"])

        for batch in batches:
            kind = batch.column(0).type
            for key, data, start, loss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if now != (key,):
                    if held:
                        yield flush()
                    now, chunk = (key,), 0
                ids = np.frombuffer(data.as_py(), "<i4").astype(np.int32)
                for at in range(0, len(ids), CHUNK):
                    if held and size + min(CHUNK, len(ids) - at) > CHUNK:
                        yield flush()
                    part = ids[at : at + CHUNK]
                    a, b = (int(np.clip(x - at, 0, len(part))) for x in ((start, len(ids) - 1) if loss else (0, 0)))
                    held.append((part, a, b))
                    size += len(part)
        if held:
            yield flush()

    kind_of = conversations.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"conv_id {kind_of}, chunk long, input_ids array<int>, loss_mask array<boolean>")


class _Reader:
    """Reads one conversation back from its ids and mask, chunk after chunk."""

    def __init__(self, own: Codec):
        self.own, self.turns, self.all, self.loss = own, 0, hashlib.sha256(), hashlib.sha256()
        self.chars = self.loss_chars = 0
        self.role = ""
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # ids and mask since the last reserved id

    def feed(self, ids: np.ndarray, mask: np.ndarray) -> None:
        at = 0
        for stop in [*np.flatnonzero(ids >= self.own.base).tolist(), len(ids)]:
            if stop > at:
                self.held.append((ids[at:stop], mask[at:stop]))
            at = stop + 1
            if stop < len(ids):
                self.control(int(ids[stop]) - self.own.base)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = (np.concatenate([h[k] for h in self.held]) for k in (0, 1)) if self.held else (np.empty(0, np.int32), np.empty(0, bool))
        self.held = []
        return ids, mask

    def control(self, code: int) -> None:
        self.chars += len(READS[code])
        ids, mask = self.read()
        written = self.own.decode(ids)
        self.chars += len(written)
        if code == TURN_END:
            text = unescape(written)
            self.all.update(f"{self.role}\n{text}\n".encode())
            if mask.any():
                said = text if mask.all() else unescape(self.own.decode(ids[mask]))
                self.loss.update(said.encode())
                self.loss_chars += len(said)
            self.turns += 1
        elif code == ROLE_END:
            self.role = unescape(written)
        elif code != OTHER_ROLE:
            self.role = ROLES[code]


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the ids and masks alone.

    Chunks must follow each other as format_conversations returns them; only one turn is held at a time.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = reader = None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), *[pa.array([x]) for x in (reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.column(0).type
            for key, ids, mask in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if now != (key,):
                    if reader:
                        yield done()
                    now, reader = (key,), _Reader(codec(path))
                reader.feed(ids.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False))
        if reader:
            yield done()

    kind_of = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "chunk", "input_ids", "loss_mask").mapInArrow(run, f"conv_id {kind_of}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
