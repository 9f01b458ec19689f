"""The tagged conversation protocol: serialise, tokenise, mask, shift, pad, check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EOT = "\x03"
#: Tokens with ids of their own, from 256 up in this order.
SPECIALS = ("<assistant>", "</assistant>", "<user>", "</user>", "<tool name=calc>", "<tool name=now>", "<tool name=search_memory>", "<tool name=web_search>", "<tool name=finish>", "</tool>", '"thought":', '"tool_call":', '"response":', '"name":', '"arguments":', "<system>", "</system>")
#: Every token begins with one of two characters, so all others are taken at once; possessive repeats neither look back nor nest.
SEGMENT = "(?s)<assistant>.*?</assistant>" + EOT + "?|(?:[^<]++|<(?!assistant>))++|<assistant>.*"


def serialise(messages: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", chat: bool = True) -> DataFrame:
    """One tagged trace a conversation: an end mark after each answering turn (chat) or at the end."""
    tag = F.concat(F.lit("<"), role, F.lit(">"), text, F.lit("</"), role, F.lit(">"))
    block = F.concat(tag, F.when(F.col(role) == "assistant", EOT).otherwise("")) if chat else tag
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    joined = F.array_join(F.transform(lines, lambda x: x["b"]), "\n")
    return messages.groupBy(key).agg((joined if chat else F.concat(joined, F.lit(EOT))).alias("trace"))


def tokenise(text: Column, max_vocab: int | None = None) -> Column:
    """Token ids: specials longest first, else the code point, 255 at most."""
    known = [(t, 256 + i) for i, t in enumerate(SPECIALS) if max_vocab is None or 256 + i < max_vocab]
    pattern = "(?s)" + "|".join(['[^<"]', *(f"\\Q{t}\\E" for t, _ in sorted(known, key=lambda x: -len(x[0]))), "."])
    ids = F.create_map(*[F.lit(y) for t in known for y in t])
    plain = lambda x: F.least(F.ascii(x), F.lit(255))
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.when(F.length(x) == 1, plain(x)).otherwise(F.element_at(ids, x)))


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(tok, n): how often each plain token occurs in all texts. Code points are counted in their UTF-8 bytes, a
    batch at a time: those below 128 are bytes, those up to 255 a lead byte and the next, all others are 255."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for b in batches:
            texts = b.column(0).drop_null().cast(pa.large_binary())
            _, at, body = texts.buffers()
            if body is None:
                continue
            at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(body, np.uint8)[at[0] : at[-1]]
            n[:128] += np.bincount(data, minlength=256)[:128]
            for lead, first in ((0xC2, 128), (0xC3, 192)):
                n[first : first + 64] += np.bincount(data[np.flatnonzero(data == lead) + 1] & 63, minlength=64)
            n[255] += int((data > 0xC3).sum())  # lead bytes of what is beyond
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], names=["tok", "n"])

    return df.select(text).mapInArrow(count, "tok int, n long").groupBy("tok").agg(F.sum("n").alias("n"))


def detokenise(tokens: Column) -> Column:
    names = F.create_map(*[F.lit(y) for i, t in enumerate(SPECIALS) for y in (256 + i, t)])
    return F.array_join(F.transform(tokens, lambda x: F.coalesce(F.try_element_at(names, x), F.char(F.least(x, F.lit(255))))), "")


def encode(text: Column, max_len: int | None = None) -> Column:
    """struct(tokens, mask): the mask is 1 in assistant blocks and the end mark right after one;
    a trace that ends with an end mark is supervised there. Truncation comes last."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0)), lambda s: F.struct(tokenise(s).alias("t"), (s.startswith("<assistant>") & s.rlike("(?s)</assistant>" + EOT + "?$")).alias("a")))
    tokens = F.flatten(F.transform(parts, lambda p: p["t"]))
    mask = F.flatten(F.transform(parts, lambda p: F.array_repeat(F.when(p["a"], 1.0).otherwise(0.0).cast("float"), F.size(p["t"]))))
    mask = F.when(text.endswith(EOT), F.concat(F.slice(mask, 1, F.greatest(F.size(mask) - 1, F.lit(0))), F.array(F.lit(1.0).cast("float")))).otherwise(mask)
    if max_len is not None:
        tokens, mask = F.slice(tokens, 1, max_len), F.slice(mask, 1, max_len)
    return F.struct(tokens.alias("tokens"), mask.alias("mask"))


def has_supervision(tokens: Column, mask: Column) -> Column:
    return (F.size(tokens) >= 2) & F.exists(F.slice(mask, 2, F.greatest(F.size(mask), F.lit(1))), lambda m: m > 0)


def shift(tokens: Column, mask: Column) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.struct(F.slice(tokens, 1, n).alias("x"), F.slice(tokens, 2, n).alias("y"), F.slice(mask, 2, n).alias("mask"))


def pad(values: Column, length: Column, value: int | float) -> Column:
    return F.concat(values, F.array_repeat(F.lit(value), F.greatest(length - F.size(values), F.lit(0))))


def within_vocabulary(tokens: Column, size: int) -> Column:
    return ~F.exists(tokens, lambda t: t >= size)


def required_vocabulary(tokens: Column, size: int) -> Column:
    """The tokens; an id that the vocabulary does not have is an error that names it."""
    return F.when(within_vocabulary(tokens, size), tokens).otherwise(F.raise_error(F.concat(F.lit("token id "), F.array_max(tokens).cast("string"), F.lit(f" is outside of the vocabulary of {size}"))))


def contract_ok(payload: Column) -> Column:
    """An assistant payload: an object with a text ``thought`` and exactly one of ``response`` (a
    text) and ``tool_call`` (an object with a text ``name`` and an object ``arguments``)."""
    v = F.try_parse_json(payload)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    has = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    is_object = lambda path: kind(path).startswith("OBJECT")
    call = is_object("$.tool_call") & (kind("$.tool_call.name") == "STRING") & is_object("$.tool_call.arguments")
    one = has("$.response") != has("$.tool_call")
    return F.coalesce(v.isNotNull() & (kind("$.thought") == "STRING") & one & F.when(has("$.response"), kind("$.response") == "STRING").otherwise(call), F.lit(False))


def payload(thought: Column, response: Column, name: Column, arguments: Column) -> Column:
    """The compact payload text; keys in protocol order, absent parts left out."""
    call = F.when(name.isNotNull(), F.struct(name.alias("name"), arguments.alias("arguments")))
    return F.to_json(F.struct(thought.alias("thought"), call.alias("tool_call"), response.alias("response")))


def assistant_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)<assistant>(.*?)</assistant>"), F.lit(1))


def tool_calls(text: Column) -> Column:
    """array of struct(name, arguments text) of the calls of assistant blocks in document order; arguments
    may be nested, and are compact JSON."""
    part = lambda b, path: F.get_json_object(b, f"$.tool_call.{path}")
    x = F.transform(assistant_blocks(text), lambda b: F.struct(part(b, "name").alias("name"), part(b, "arguments").alias("arguments")))
    return F.filter(x, lambda c: c["name"].isNotNull())


def tool_rollup(names: Column) -> Column:
    return F.array_join(names, "->")


def conversation_rollup(turns: Column) -> Column:
    """Tool names of each turn (an array of arrays) joined by an arrow, turns by a bar; a turn without calls is a dash."""
    return F.array_join(F.transform(turns, lambda t: F.when(F.size(t) > 0, tool_rollup(t)).otherwise("-")), " | ")


def truncate_keeping_answer(text: Column, limit: int) -> Column:
    """Keep the last assistant block whole and cut the head to what is left of ``limit``."""
    tail = F.regexp_extract(text, "(?s)^.*(<assistant>.*)$", 1)
    cut = F.concat(F.substring(text, F.lit(1), F.greatest(F.lit(limit) - F.length(tail), F.lit(0))), tail)
    return F.when(F.length(text) <= limit, text).when(tail == "", F.substring(text, 1, limit)).otherwise(cut)


def observation_view(content: Column, obs_id: Column, offset: Column | None = None, window: int = 400, cap: int = 8000) -> Column:
    """A window of a stored observation from an offset, and where it stands."""
    body, at = F.substring(content, 1, cap), F.greatest(F.coalesce(offset, F.lit(0)), F.lit(0)) if offset is not None else F.lit(0)
    end = F.least(F.length(body), at + window)
    note = F.format_string("\n[%s: %d bytes, showing %d-%d]", obs_id, F.length(body), at, end)
    return F.concat(F.substring(body, at + 1, F.greatest(end - at, F.lit(0))), note)


def observations(results: DataFrame, trace: str, order: str, content: str = "content", direct: int = 180) -> DataFrame:
    """``results`` with obs_id and view: short ones pass as they are and have no id, others are
    numbered within their trace in the order of their coming and show their first window."""
    from pyspark.sql import Window

    large = F.length(content) > direct
    n = F.count(F.when(large, 1)).over(Window.partitionBy(trace).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    x = results.withColumn("obs_id", F.when(large, F.concat(F.lit("obs_"), n.cast("string"))))
    return x.withColumn("view", F.when(F.col("obs_id").isNull(), F.col(content)).otherwise(observation_view(F.col(content), F.col("obs_id"))))
