"""Model-API requests and responses: messages, tool calls, tool results, turn actions.

Bodies are read as VARIANT, which keeps the difference between a string and an array
of parts without a second parse."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import schemas
from palisade.functions.hashing import fnv64
from palisade.functions.jsonfields import bool_at, number_at, parse_whole, string_at, type_at, variant_at, whole_at
from palisade.functions.text import lossy_text, shorten
from palisade.operators.classify import classify_payloads
from palisade.operators.h2 import body_of
from palisade.operators.normalize import action_of
from palisade.plans.stage import settle

_PREVIEW = 200
_PART = "struct<type:string,text:string,name:string,id:string,input:variant,tool_use_id:string,content:variant>"
_MESSAGE = "struct<role:string,content:variant,tool_call_id:string,name:string,tool_calls:variant>"
_NO_TEXT = "array<string>"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_array(v: Column) -> Column:
    return F.startswith(_kind(v), F.lit("ARRAY"))


def _is_text(v: Column) -> Column:
    return _kind(v) == "STRING"


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _parts(v: Column) -> Column:
    return F.try_variant_get(v, "$", f"array<{_PART}>")


def _empty() -> Column:
    return F.array().cast(_NO_TEXT)


def _inner_texts(content: Column) -> Column:
    """Texts of a tool result: its string, or the texts of its blocks."""
    blocks = F.array_compact(F.transform(_parts(content), lambda b: b["text"]))
    return F.when(_is_text(content), F.array(_text(content))).when(_is_array(content), blocks).otherwise(_empty())


def _flat_openai(content: Column) -> Column:
    texts = F.transform(F.filter(_parts(content), lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.when(_is_text(content), _text(content)).when(_is_array(content), F.array_join(texts, "\n"))


def _flat_anthropic(content: Column) -> Column:
    per_block = F.transform(
        _parts(content), lambda b: F.concat(F.array_compact(F.array(b["text"], b["name"])), _inner_texts(b["content"]))
    )
    return F.when(_is_text(content), _text(content)).when(_is_array(content), F.array_join(F.flatten(per_block), "\n"))


def _absent(v: Column, path: str) -> Column:
    return F.coalesce(type_at(v, path), F.lit("VOID")) == "VOID"


def _optional(v: Column, path: str, value: Column) -> Column:
    return _absent(v, path) | value.isNotNull()


def _order(sni: Column, anthropic: Column, openai: Column) -> Column:
    low = F.lower(sni)
    openai_first = F.contains(low, F.lit("openai")) & ~F.contains(low, F.lit("anthropic"))
    return F.when(F.coalesce(openai_first, F.lit(False)), F.coalesce(openai, anthropic)).otherwise(F.coalesce(anthropic, openai))


def _request(provider: str, v: Column, messages: Column, system: Column, max_tokens: Column, results: Column) -> Column:
    flat = _flat_anthropic if provider == "Anthropic" else _flat_openai
    listed = F.transform(
        messages, lambda m: F.struct(m["role"].alias("role"), F.coalesce(flat(m["content"]), F.lit("")).alias("content"))
    )
    users = F.filter(listed, lambda m: m["role"] == "user")
    return F.struct(
        F.lit(provider).alias("provider"),
        string_at(v, "$.model").alias("model"),
        F.coalesce(bool_at(v, "$.stream"), F.lit(False)).alias("stream"),
        system.alias("system_prompt"),
        F.try_element_at(users, F.lit(-1))["content"].alias("user_message"),
        number_at(v, "$.temperature").alias("temperature"),
        max_tokens.alias("max_tokens"),
        listed.alias("messages"),
        results.alias("tool_results"),
    )


def _result(name: Column, use_id: Column, output: Column) -> Column:
    return F.struct(name.alias("name"), use_id.alias("tool_use_id"), shorten(output, _PREVIEW).alias("output_preview"), output.alias("output"))


def parse_llm_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Add `request`: provider format, model, prompts, messages, tool results; null when neither format fits."""
    staged = settle(bodies, _v=parse_whole(F.col(body)))
    v = F.col("_v")
    staged = settle(staged, _m=F.try_variant_get(v, "$.messages", f"array<{_MESSAGE}>"))
    m = F.col("_m")
    usable = (
        (F.size(m) > 0)
        & F.forall(m, lambda x: x["role"].isNotNull())
        & _optional(v, "$.model", string_at(v, "$.model"))
        & _optional(v, "$.temperature", number_at(v, "$.temperature"))
        & _optional(v, "$.max_tokens", whole_at(v, "$.max_tokens"))
        & (type_at(v, "$.stream").isNull() | bool_at(v, "$.stream").isNotNull())
    )
    told = lambda c: _is_text(c) | _is_array(c)
    system = variant_at(v, "$.system")
    system_ok = _absent(v, "$.system") | told(system)
    system_text = F.when(_is_text(system), _text(system)).when(
        _is_array(system), F.array_join(F.array_compact(F.transform(_parts(system), lambda b: b["text"])), "\n")
    )
    blocks = F.flatten(F.transform(m, lambda x: F.coalesce(_parts(x["content"]), F.array().cast(f"array<{_PART}>"))))
    block_results = F.transform(
        F.filter(blocks, lambda b: b["type"] == "tool_result"),
        lambda b: _result(b["name"], b["tool_use_id"], F.when(told(b["content"]), F.array_join(_inner_texts(b["content"]), "\n"))),
    )
    anthropic = F.when(
        usable & system_ok & F.forall(m, lambda x: told(x["content"])),
        _request("Anthropic", v, m, system_text, whole_at(v, "$.max_tokens"), block_results),
    )
    system_rows = F.array_compact(
        F.transform(F.filter(m, lambda x: x["role"] == "system"), lambda x: _flat_openai(x["content"]))
    )
    tool_rows = F.transform(
        F.filter(m, lambda x: x["role"] == "tool"), lambda x: _result(x["name"], x["tool_call_id"], _flat_openai(x["content"]))
    )
    openai = F.when(
        usable
        & _optional(v, "$.max_completion_tokens", whole_at(v, "$.max_completion_tokens"))
        & F.forall(m, lambda x: told(x["content"]) | (_kind(x["content"]) == "VOID")),
        _request(
            "OpenAI", v, m,
            F.when(F.size(system_rows) > 0, F.array_join(system_rows, "\n")),
            F.coalesce(whole_at(v, "$.max_tokens"), whole_at(v, "$.max_completion_tokens")),
            tool_rows,
        ),
    )
    staged = settle(staged, _a=anthropic, _o=openai)
    return settle(staged, request=_order(F.col("sni"), F.col("_a"), F.col("_o"))).drop("_v", "_m", "_a", "_o")


_CALL = "struct<id:string,function:struct<name:string,arguments:string>>"


def _call(name: Column, args: Column, call_id: Column) -> Column:
    return F.struct(name.alias("name"), args.alias("input_json"), call_id.alias("tool_call_id"))


def parse_llm_responses(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Add `response`: provider format, model, text, tool calls; null when neither format fits."""
    staged = settle(bodies, _v=parse_whole(F.col(body)))
    v = F.col("_v")
    choices = F.try_variant_get(v, "$.choices", f"array<struct<message:{_MESSAGE}>>")
    texts = F.filter(F.transform(choices, lambda c: _flat_openai(c["message"]["content"])), lambda t: F.coalesce(t != "", F.lit(False)))
    calls = F.flatten(
        F.transform(
            choices,
            lambda c: F.coalesce(F.try_variant_get(c["message"]["tool_calls"], "$", f"array<{_CALL}>"), F.array().cast(f"array<{_CALL}>")),
        )
    )
    named = F.transform(
        F.filter(calls, lambda c: c["function"]["name"].isNotNull()),
        lambda c: _call(c["function"]["name"], c["function"]["arguments"], c["id"]),
    )
    joined = lambda t: F.when(F.size(t) > 0, F.array_join(t, "\n"))
    model_ok = _optional(v, "$.model", string_at(v, "$.model"))
    answer = lambda provider, t, c: F.struct(
        F.lit(provider).alias("provider"), string_at(v, "$.model").alias("model"), joined(t).alias("text"), c.alias("tool_calls")
    )
    openai = F.when(model_ok & (F.size(choices) > 0), answer("OpenAI", texts, named))

    content = variant_at(v, "$.content")
    blocks = F.coalesce(_parts(content), F.array().cast(f"array<{_PART}>"))
    block_texts = F.array_compact(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]))
    block_calls = F.transform(
        F.filter(blocks, lambda b: (b["type"] == "tool_use") & b["name"].isNotNull()),
        lambda b: _call(b["name"], F.to_json(b["input"]), b["id"]),
    )
    has_content = _is_array(content)
    is_message = F.coalesce(string_at(v, "$.type") == "message", F.lit(False))
    is_object = F.startswith(_kind(v), F.lit("OBJECT"))
    anthropic = F.when(
        is_object & model_ok & (has_content | (is_message & _absent(v, "$.content"))), answer("Anthropic", block_texts, block_calls)
    )
    staged = settle(staged, _a=anthropic, _o=openai)
    return settle(staged, response=_order(F.col("sni"), F.col("_a"), F.col("_o"))).drop("_v", "_a", "_o")


# ---------------------------------------------------------------- explosions


def explode_messages(requests: DataFrame, keep=("session_id", "seq")) -> DataFrame:
    rows = requests.select(*keep, F.posexplode("request.messages").alias("idx", "_m"))
    return rows.select(*keep, "idx", F.col("_m.role").alias("role"), F.col("_m.content").alias("content"))


def explode_tool_results(requests: DataFrame, keep=("session_id", "seq")) -> DataFrame:
    return requests.select(*keep, F.posexplode("request.tool_results").alias("idx", "_r")).select(*keep, "idx", "_r.*")


def explode_tool_calls(responses: DataFrame, keep=("session_id", "seq")) -> DataFrame:
    return responses.select(*keep, F.posexplode("response.tool_calls").alias("idx", "_c")).select(*keep, "idx", "_c.*")


def mcp_capabilities(mcp_responses: DataFrame, key="session_id") -> DataFrame:
    """Per identity, FNV-64 of the sorted distinct tool names listed in its responses (one name per line)."""
    tools = F.try_variant_get(parse_whole(F.col("body")), "$.result.tools", "array<struct<name:string>>")
    names = mcp_responses.select(key, F.explode(tools).alias("_t")).select(key, F.col("_t.name").alias("tool"))
    distinct = names.filter(F.col("tool").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    return distinct.withColumn("capability_hash", fnv64(F.array_join("tools", "\n")))


# ---------------------------------------------------------------- turns


def with_h2_bodies(read: DataFrame) -> DataFrame:
    """HTTP/2 turns get the text of their DATA frames as body, so they parse like any other."""
    framed = F.when(F.col("protocol") == "Http2Binary", F.col("payload"))
    staged = read.withColumn("_h2", body_of(framed))
    return staged.withColumn("body", F.coalesce("body", lossy_text(F.col("_h2")))).drop("_h2")


def turns_to_actions(turns: DataFrame) -> DataFrame:
    """Flat-map turns (direction 0 write / 1 read, payload, sni) to action structs, in order.

    Result columns: those of `turns` without the payload, plus action_idx and action."""
    keep = [c for c in turns.columns if c != "payload"]
    read = parse_llm_responses(parse_llm_requests(with_h2_bodies(classify_payloads(turns))))
    size = F.octet_length("payload").cast("bigint")
    flagged = F.when(F.col("pii_any"), F.lit(True))
    nothing = F.array().cast(f"array<{schemas.ACTION.simpleString()}>")
    req, resp = F.col("request"), F.col("response")
    of_model = dict(bytes=size, sni=F.col("sni"), confidence=F.col("confidence"))
    of_prompt = dict(
        of_model, sdk=F.col("sdk"), endpoint=F.col("endpoint"), fingerprint=F.col("signature_hash"),
        pii_detected=flagged, sdk_hash=F.col("sdk_hash"), model_hash=F.col("model_hash"),
    )
    prompt = action_of(
        "Prompt", provider=req["provider"], model=req["model"], user_message=req["user_message"],
        system_prompt=req["system_prompt"], stream=req["stream"], **of_prompt,
    )
    plain_prompt = action_of(
        "Prompt", provider=F.coalesce("provider", F.lit("unknown")), model=F.col("model"), stream=F.lit(False), **of_prompt
    )
    results = F.transform(
        req["tool_results"],
        lambda r: action_of("ToolResult", tool_name=F.coalesce(r["name"], F.lit("unknown")), output_preview=r["output_preview"], output=r["output"]),
    )
    pii = lambda way: F.when(F.col("pii_any"), action_of("PiiDetected", direction=F.lit(way), pii_types=F.col("pii_types")))
    method = F.coalesce(F.col("mcp_method"), F.lit("unknown"))
    mcp_request = action_of("McpRequest", method=method, category=F.col("mcp_category"))
    write = (
        F.when(req.isNotNull(), F.concat(results, F.array(prompt, pii("write"))))
        .when(F.col("content_class") == "Mcp", F.array(mcp_request))
        .when(F.col("is_interesting"), F.array(plain_prompt))
        .otherwise(nothing)
    )
    calls = F.transform(
        resp["tool_calls"],
        lambda c: action_of("ToolCall", tool_name=c["name"], input_json=c["input_json"], provider=resp["provider"]),
    )
    answer = action_of("Response", provider=resp["provider"], model=resp["model"], **of_model)
    plain_answer = action_of("Response", provider=F.coalesce("provider", F.lit("unknown")), model=F.col("model"), **of_model)
    stream_answer = action_of("Response", provider=F.col("provider"), **of_model)
    got = (
        F.when(resp.isNotNull(), F.concat(calls, F.array(answer, pii("read"))))
        .when(F.col("content_class") == "Mcp", F.array(action_of("McpResponse", method=method)))
        .when(F.col("content_class") == "LlmStream", F.array(stream_answer))
        .when(F.col("is_interesting"), F.array(plain_answer))
        .otherwise(nothing)
    )
    actions = F.when(F.octet_length("payload") == 0, nothing).when(F.col("direction") == 0, write).otherwise(got)
    rows = settle(read, _actions=F.array_compact(actions))
    return rows.select(*keep, F.posexplode("_actions").alias("action_idx", "action"))

