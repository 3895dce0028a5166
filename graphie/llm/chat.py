"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once from its turns, encoded once with character offsets, and the
sorted spans of its assistant texts are met with the sorted spans of its tokens by binary search.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a backslash
goes between ``<`` and ``|`` (one more where there are some already), so no control string can
appear there and the original comes back exactly. The whole header of a trained turn is one control
token, so no token crosses the border between header and text: what is under the mask is the text.

Turns of a conversation meet sorted in one task and are read as a stream. A conversation is
rendered and encoded in parts of about ``PART_CHARS``; a part ends after a turn, where the
control token cuts the encoding anyway, so parts joined are the whole and memory is bounded by
the longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART_CHARS = 1 << 20
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = (
    "conv_id bigint, part int, last boolean, n_turns bigint, formatted string, token_ids array<int>, "
    "loss_mask array<boolean>, loss_spans array<struct<start:bigint,end:bigint>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """Also without line ends, which close a role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans in it of the texts to train on."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role == trained:
            spans.append((at, at + len(body)))
        out += [head, body, END, "\n"]
        at += len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def align(spans: list[tuple[int, int]], offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Token mask, and the characters under it, as the tokens lie. Offsets are sorted starts and ends."""
    mask, covered = np.zeros(len(offsets), bool), []
    starts, ends = (offsets[:, 0], offsets[:, 1]) if len(offsets) else (np.zeros(0, int), np.zeros(0, int))
    for start, end in spans:
        first, after = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
        if first < after and start < end:
            mask[first:after] = True
            covered.append((int(starts[first]), int(ends[after - 1])))
    return mask, covered


def _tokenizer(definition: str, trained: str = "assistant"):
    from tokenizers import AddedToken, Tokenizer, processors

    tok = Tokenizer.from_str(definition)
    tok.no_truncation()
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    tok.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in (START, END, f"{START}{escape_role(trained)}\n")])
    return tok


def _format_parts(definition: str, trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(definition, trained)
        arrow = pa.schema([
            ("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()),
            ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
            ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ])
        ready: list[tuple] = []  # parts that wait for encoding
        turns: list[tuple[str, str]] = []
        conv, part, chars, held = None, 0, 0, 0

        def encoded() -> pa.RecordBatch:
            rendered = [render(t, trained) for _, _, _, t in ready]
            rows, ids, masks = [], [], []
            for (c, p, last, t), (text, spans), enc in zip(ready, rendered, tok.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
                mask, covered = align(spans, np.asarray(enc.offsets, dtype=np.int64).reshape(-1, 2))
                rows.append((c, p, last, len(t), text, [{"start": s, "end": e} for s, e in covered]))
                ids.append(np.asarray(enc.ids, dtype=np.int32))
                masks.append(mask)
            ready.clear()
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (ids, masks)]
            *plain, spans = (pa.array(list(x), f.type) for x, f in zip(zip(*rows), [*list(arrow)[:5], arrow.field("loss_spans")]))
            return pa.RecordBatch.from_arrays([*plain, *lists, spans], schema=arrow)

        started = False
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if started and (c != conv or chars >= PART_CHARS):
                    ready.append((conv, part, c != conv, turns))
                    part = 0 if c != conv else part + 1
                    held, turns, chars = held + chars, [], 0
                    if held >= PART_CHARS:
                        yield encoded()
                        held = 0
                conv, started = c, True
                turns.append((role or "", text or ""))
                chars += len(text or "") + len(role or "")
        if turns:
            ready.append((conv, part, True, turns))
        if ready:
            yield encoded()

    return run


def format_conversations(
    turns: DataFrame, tokenizer: str = TOKENIZER, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant"
) -> DataFrame:
    """Formatted parts of each conversation, in order, with token ids, loss mask and loss spans.

    Turns are ordered by number (null first), then role and text, so ties have one order; repeated
    rows are repeated turns. Null roles and texts count as empty; rows with a null conversation
    form one. No rows give no rows. Other columns are ignored. ``tokenizer`` is a file the driver
    reads (a byte-level vocabulary in JSON); executors get its text with the task.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    rows = turns.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(role).alias("role"), F.col(text).alias("text"), F.col(turn).alias("turn")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format_parts(definition, trained), SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    n = chars = loss = tokens = trained = 0
    whole, under = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        done = []
        masks = batch.column("loss_mask")
        sums = np.r_[0, np.cumsum(masks.flatten().to_numpy(zero_copy_only=False))]
        ends = np.r_[0, np.cumsum(pc.list_value_length(masks).to_numpy(zero_copy_only=False))].astype(int)
        under_mask, sizes = np.diff(sums[ends]), np.diff(ends)
        for r, n_all, n_under in zip(batch.select(["conv_id", "last", "formatted", "loss_spans"]).to_pylist(), sizes, under_mask):
            text = r["formatted"]
            for role, said in parse(text):
                n += 1
                whole.update(f"{role}\n{said}\n".encode())
            for s in r["loss_spans"]:
                plain = unescape(text[s["start"] : s["end"]])
                loss += len(plain)
                under.update(plain.encode())
            chars, tokens, trained = chars + len(text), tokens + int(n_all), trained + int(n_under)
            if r["last"]:
                done.append((r["conv_id"], n, whole.hexdigest(), loss, under.hexdigest(), chars, tokens, trained))
                n = chars = loss = tokens = trained = 0
                whole, under = hashlib.sha256(), hashlib.sha256()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names=names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted parts as they come (in order, unshuffled)."""
    return formatted.mapInArrow(
        _digests,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
        "n_tokens bigint, n_loss_tokens bigint",
    )
