"""Request and response tables: header rules, presets, credentials, body limits and text fields of nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bodies

MAX_BODY = 16 * 1024 * 1024
RESPONSE_HEADERS = r"^(retry-after|x-request-id|x-ratelimit.*|openai-.*|anthropic-.*)$"

#: What a provider's preset sets: the path of chat requests, and the request headers that pass.
PRESETS = {
    "openai": ("/v1/chat/completions", ["openai-organization", "openai-project"]),
    "copilot": ("/chat/completions", ["editor-version", "editor-plugin-version", "copilot-integration-id", "openai-intent"]),
    "anthropic": ("/v1/chat/completions", ["anthropic-version", "anthropic-beta"]),
}


def forwardable(headers: Column) -> Column:
    """Response headers that may be passed on."""
    return F.map_filter(headers, lambda k, v: F.lower(k).rlike(RESPONSE_HEADERS))


def allowed(headers: Column, names: list[str]) -> Column:
    """Request headers on an allowlist, whatever their case."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin([n.lower() for n in names]))


def parse_header_list(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def parse_extra_headers(raw: Column) -> Column:
    pairs = F.filter(F.split(raw, ";"), lambda p: F.instr(p, "=") > 1)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.regexp_replace(p, "^[^=]*=", "")))))


def env_flag(raw: Column) -> Column:
    return F.coalesce(F.lower(F.trim(raw)).isin("1", "true", "yes", "on"), F.lit(False))


def preset(provider: Column) -> Column:
    """Struct of a provider's chat path and the headers that pass; unknown providers get those of openai."""
    entry = lambda v: F.struct(F.lit(v[0]).alias("chat_path"), F.array(*map(F.lit, v[1])).alias("forward_headers"))
    known = F.create_map(*[x for k, v in PRESETS.items() for x in (F.lit(k), entry(v))])
    return F.coalesce(F.try_element_at(known, provider), entry(PRESETS["openai"]))


def valid_url(url: Column) -> Column:
    """Whether a URL is http or https and has a host."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0), F.lit(False))


def redact_url(url: Column) -> Column:
    """A URL for logs: user and password are hidden, up to the last @ before the host ends; whatever is no http or https
    URL with a host is hidden whole."""
    hidden = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1<redacted>@")
    host = F.regexp_extract(hidden, r"^(?i:https?)://(?:<redacted>@)?([^/?#@\s:]+|\[[0-9A-Fa-f:.]+\])(?::[0-9]*)?(?:[/?#]|\z)", 1)
    return F.when(F.length(host) > 0, hidden).otherwise(F.when(url.isNotNull(), F.lit("<unprintable>")))


def credential(authorization: Column, api_key: Column, configured: Column) -> Column:
    """Which credential a request uses; the decision, never the secret."""
    return F.when(authorization.isNotNull(), "client_authorization").when(api_key.isNotNull(), "client_api_key").when(configured.isNotNull(), "configured").otherwise("rejected")


def admit(requests: DataFrame, limit: int = MAX_BODY) -> DataFrame:
    """Adds `status`: blocked bodies are too long or no JSON object; nothing of them is passed on."""
    parsed = F.try_parse_json("body")
    return requests.withColumn("status", F.when(F.octet_length("body") > limit, "blocked").when(parsed.isNull(), "blocked").otherwise("ok"))


def openai_fields(requests: DataFrame) -> DataFrame:
    """request_id, field_ord, path, text: every text of the bodies in one shape, in reading order."""
    return bodies.fields(requests, "openai")


def anthropic_fields(requests: DataFrame) -> DataFrame:
    """As openai_fields, for the other shape."""
    return bodies.fields(requests, "anthropic")
