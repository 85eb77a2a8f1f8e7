"""Chat formatting: conversations become turn-aligned windows under a token budget, with a loss mask."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of a window, and of the earlier turns that a window repeats.
BUDGET, HISTORY = 1024, 256
#: How the vocabulary's authors cut text before merging: a fixed public pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The template: what stands before and behind a turn's text.  Control strings hold "<" or "[", which no escaped text does.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
_OTHER = ("[ROLE]", "[/ROLE]", "</s>")
_ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))


def escape(text: str) -> str:
    for plain, safe in _ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    out, parts = [], text.split("\\\\")
    for part in parts:
        out.append(part.replace("\\l", "<").replace("\\b", "["))
    return "\\".join(out)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text lies in it."""
    if role in TEMPLATE:
        before, behind = TEMPLATE[role]
    else:
        before, behind = _OTHER[0] + escape(role) + _OTHER[1], _OTHER[2]
    safe = escape(text)
    return before + safe + behind, len(before), len(before) + len(safe)


def parse(formatted: str) -> Iterator[tuple[str, int, int]]:
    """The turns of a formatted window: role, start and end of the escaped text."""
    at = 0
    while at < len(formatted):
        if formatted.startswith(_OTHER[0], at):
            close = formatted.index(_OTHER[1], at)
            role, start, behind = unescape(formatted[at + len(_OTHER[0]) : close]), close + len(_OTHER[1]), _OTHER[2]
        else:
            role = next(r for r, (before, _) in TEMPLATE.items() if formatted.startswith(before, at))
            start, behind = at + len(TEMPLATE[role][0]), TEMPLATE[role][1]
        end = formatted.index(behind.strip(), start) - (len(behind) - len(behind.lstrip()))
        yield role, start, end
        at = end + len(behind)


@cache
def _tokens(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_WINDOWS = "conv_id bigint, window bigint, first_turn bigint, repeated bigint, kept_system boolean, n_tokens bigint, text string, loss array<struct<start:bigint,end:bigint>>"


def _counted(path: str):
    """Adds the tokens of each rendered turn, where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _tokens(path)
        for part, _, _ in slices(batches):
            tokens = [len(count.encode_ordinary(render(role or "", text or "")[0])) for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens, pa.int64())], names=[*part.schema.names, "tokens"])

    return run


def _format(budget: int, history: int):
    """Sorted turns in, windows out.  Only the current window's and the repeatable turns are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        conv, system, window, new, past, seen = None, None, 0, [], [], 0

        def emit() -> None:
            # prefix sums of tokens choose the span: new turns, and as many earlier turns as the history holds
            nonlocal window
            total, keep = sum(t[3] for t in new), []
            used = 0
            for turn in reversed(past):
                if used + turn[3] > history or total + used + turn[3] + (system[3] if system else 0) > budget:
                    break
                keep.insert(0, turn)
                used += turn[3]
            lead = [system] if system and window else []
            text, loss = "", []
            for k, turn in enumerate([*lead, *keep, *new]):
                piece, start, end = render(turn[1], turn[2])
                if turn[1] == "assistant" and k >= len(lead) + len(keep):
                    loss.append({"start": len(text) + start, "end": len(text) + end})
                text += piece
            out.append({"conv_id": conv, "window": window, "first_turn": new[0][0], "repeated": len(keep), "kept_system": bool(lead), "n_tokens": total + used + sum(t[3] for t in lead), "text": text, "loss": loss})
            window += 1
            past[:] = [t for t in [*past, *new] if t is not system]
            size = 0
            for k in range(len(past) - 1, -1, -1):
                size += past[k][3]
                if size > history:
                    del past[: k + 1]
                    break

        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("repeated", pa.int64()), ("kept_system", pa.bool_()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        began = False
        for part, _, _ in slices(batches):
            for cid, role, text, tokens in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens")), strict=True):
                if not began or cid != conv:
                    if new:
                        emit()
                    conv, system, window, new, past, seen, began = cid, None, 0, [], [], 0, True
                role, text = role or "", text or ""
                turn = (seen, role, text, tokens)
                base = system[3] if system and window else 0
                carried = sum(t[3] for t in past) if window else 0
                if new and base + carried + sum(t[3] for t in new) + turn[3] > budget:
                    emit()
                    new = []
                new.append(turn)
                if seen == 0 and role == "system":
                    system = turn
                seen += 1
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if new:
            emit()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    conv, began = None, False
    turns, loss, n_turns, n_loss, n_chars, n_windows = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return made

    for batch in batches:
        for w in (row for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
            if not began or w["conv_id"] != conv:
                if began:
                    out.append((conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars, n_windows))
                conv, began = w["conv_id"], True
                turns, loss, n_turns, n_loss, n_chars, n_windows = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            n_chars, n_windows = n_chars + len(w["text"]), n_windows + 1
            skip = w["repeated"] + w["kept_system"]
            for k, (role, start, end) in enumerate(parse(w["text"])):
                if k >= skip:
                    turns.update(f"{role}\n{unescape(w['text'][start:end])}\n".encode("utf-8", "surrogatepass"))
                    n_turns += 1
            for span in w["loss"]:
                text = unescape(w["text"][span["start"] : span["end"]])
                n_loss += len(text)
                loss.update(text.encode("utf-8", "surrogatepass"))
        if len(out) >= 512:
            yield rows()
    if began:
        out.append((conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars, n_windows))
    if out:
        yield rows()


def format_conversations(turns: DataFrame, path: str = VOCABULARY, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of formatted conversations: ``conv_id, window, first_turn, repeated, kept_system, n_tokens, text, loss``.

    ``turns``: conv_id, turn, role, text.  A conversation's rows go in the order of turn, then role, then text (ties and repeated
    rows all count as turns).  A window takes whole turns while their tokens, with what it repeats, fit ``budget``; one turn over the
    budget makes a window of its own, and a history that would not fit beside its first turn is shortened.  A later window begins with the conversation's system turn, if its first turn is one, and repeats the last turns
    that fit ``history`` tokens; neither is under the loss mask again, so each assistant text is masked in once.
    ``loss`` holds code point spans of escaped assistant texts.  Null text and role are empty; a null turn comes first; rows of a null conv_id
    form one conversation; an empty table gives no rows; other columns are ignored.  Tokens are counted where the rows lie; then each conversation's turns are streamed
    in order through one task, as each window depends on the one before: a conversation of any length takes the memory of one window.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_counted(path), "conv_id bigint, turn bigint, role string, text string, tokens bigint")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format(budget, history), _WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Parse the output of ``format_conversations``, in its own order, back into digests of each conversation's turns and loss."""
    return windows.mapInArrow(_read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
