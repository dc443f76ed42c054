"""Typed fields of a JSON body: strict when the body parses, a key scan when it was cut off."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.plans.stage import settle

# possessive quantifiers keep the scan iterative, so long strings cannot exhaust the stack
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+'
_WS = r"[ \t\r\n]*+"
# a string; if closed, maybe followed by ':' and a scalar; if not closed, the rest of the body
_TOKEN = rf'(?s){_STRING}(?:"(?:{_WS}:{_WS}(?:{_STRING}"|[0-9.eE-]++|true|false)?+)?+|\\?\z)'
_KEYED = rf'(?s)^{_STRING}"{_WS}:'

FLAGS = ["messages", "prompt", "result", "error", "choices", "content", "completion"]


def parse_whole(body: Column) -> Column:
    """The body as a variant, null unless the whole text is one JSON value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    return F.when(variant_at(wrapped, "$[1]").isNull(), variant_at(wrapped, "$[0]"))


def variant_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def type_at(v: Column, path: str) -> Column:
    return F.schema_of_variant(variant_at(v, path))


def string_at(v: Column, path: str) -> Column:
    return F.when(type_at(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def number_at(v: Column, path: str) -> Column:
    return F.when(_is_number(type_at(v, path)), F.try_variant_get(v, path, "double"))


def whole_at(v: Column, path: str) -> Column:
    value = F.try_variant_get(v, path, "bigint")
    return F.when((type_at(v, path) == "BIGINT") & (value >= 0), value)


def bool_at(v: Column, path: str) -> Column:
    return F.when(type_at(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def _parsed(v: Column, body: Column) -> dict[str, Column]:
    keys = F.coalesce(F.array_sort(F.json_object_keys(body)), F.array().cast("array<string>"))
    id_type = type_at(v, "$.id")
    limit = F.when(_is_number(type_at(v, "$.max_completion_tokens")), whole_at(v, "$.max_completion_tokens"))
    return {
        "model": string_at(v, "$.model"),
        "temperature": number_at(v, "$.temperature"),
        "max_tokens": limit.otherwise(whole_at(v, "$.max_tokens")),
        "top_p": number_at(v, "$.top_p"),
        "stream": bool_at(v, "$.stream"),
        "jsonrpc": string_at(v, "$.jsonrpc"),
        "method": string_at(v, "$.method"),
        "id": F.when(_is_number(id_type) | (id_type == "STRING"), F.try_variant_get(v, "$.id", "string")),
        "keys": keys,
    }


def _scanned(tokens: Column) -> Column:
    return F.transform(
        F.filter(tokens, lambda t: t.rlike(_KEYED)),
        lambda t: F.struct(
            F.regexp_extract(t, rf'(?s)^"([^"\\]*+(?:\\.[^"\\]*+)*+)"{_WS}:', 1).alias("key"),
            F.regexp_replace(t, _KEYED + _WS, "").alias("raw"),
        ),
    )


def _last_raw(entries: Column, *keys) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"].isin(*keys)), F.lit(-1))["raw"]


def _scan_fields(entries: Column) -> dict[str, Column]:
    text = lambda raw: F.when(F.startswith(raw, F.lit('"')), F.regexp_extract(raw, r'(?s)^"(.*)"$', 1))
    number = lambda raw: F.when(raw.rlike(r"^[0-9.eE-]+$"), raw.try_cast("double"))
    model, temp, top_p = _last_raw(entries, "model"), _last_raw(entries, "temperature"), _last_raw(entries, "top_p")
    tokens = number(_last_raw(entries, "max_tokens", "max_completion_tokens"))
    ident = _last_raw(entries, "id")
    stream = _last_raw(entries, "stream")
    keys = F.transform(entries, lambda e: e["key"])
    return {
        "model": text(model),
        "temperature": number(temp),
        "max_tokens": F.when(tokens.isNotNull(), F.greatest(tokens, F.lit(0.0)).cast("bigint")),
        "top_p": number(top_p),
        "stream": F.when(stream == "true", True).when(stream == "false", False),
        "jsonrpc": text(_last_raw(entries, "jsonrpc")),
        "method": text(_last_raw(entries, "method")),
        "id": F.coalesce(text(ident), number(ident).cast("bigint").cast("string")),
        "keys": F.transform(entries, lambda e: e["key"]),
    }


def with_json_fields(df: DataFrame, body: str = "body") -> DataFrame:
    """Add the probed fields as columns j_model, j_temperature, ..., j_keys, j_has_<key> and
    j_complete; null (flags: false) where there is no body. They stay flat columns because
    later steps read single fields."""
    text = F.col(body)
    staged = settle(df, _v=parse_whole(text))
    unparsed = text.isNotNull() & F.col("_v").isNull()
    staged = settle(staged, _tokens=F.when(unparsed, F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))))
    staged = settle(staged, _entries=_scanned(F.col("_tokens")))
    whole = F.col("_v").isNotNull()
    strict, scanned = _parsed(F.col("_v"), text), _scan_fields(F.col("_entries"))
    fields = {f"j_{n}": F.when(whole, strict[n]).when(text.isNotNull(), scanned[n]) for n in strict}
    staged = settle(staged, j_complete=F.when(text.isNotNull(), whole), **fields)
    has = {f"j_has_{k}": F.coalesce(F.array_contains("j_keys", k), F.lit(False)) for k in FLAGS}
    return settle(staged, **has).drop("_v", "_tokens", "_entries")
