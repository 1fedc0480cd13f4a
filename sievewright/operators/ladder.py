"""The two-rung cascade: blocked pages cost nothing, the large model sees only what the small one left.

Each rung is an explicit filter before its provider (a UDF inside ``when`` would run for every row) and
is written before it branches, as provider calls are side effects.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.prompt import prompt_hash
from sievewright.session import materialise

#: Site types, thresholds, reasons.
SITE_TYPES = "news_outlet magazine blog_personal corporate ecommerce marketplace forum_community social_platform government education academic_research reference_wiki saas_product portfolio directory_aggregator media_streaming gambling_adult other".split()
ACCEPT_SMALL, ACCEPT_LARGE, EVIDENCE_CHARS, MOST_TOPICS = 0.75, 0.60, 300, 3
FAILED, DISABLED = "LLM classification failed", "classification disabled (mode=off)"
TOPICS = "array<struct<tier1_id:string,tier2_id:string,confidence:double>>"
VERDICT = f"site_type string, site_type_confidence double, topics {TOPICS}, audience_geo string, evidence string, uncertain_because string, error string, tokens_in int, tokens_out int"
#: What a verdict carries beside its site type, with types; missing columns of a provider are null.
CARRIED = {"topics": TOPICS, "audience_geo": "string", "evidence": "string", "uncertain_because": "string", "model_id": "string", "prompt_sha256": "string", "tokens_in": "int", "tokens_out": "int"}
#: The reply that a model is asked for, as a JSON schema.
REPLY_SCHEMA = {
    "type": "object", "required": ["site_type", "site_type_confidence", "topics"],
    "properties": {
        "site_type": {"anyOf": [{"enum": SITE_TYPES}, {"type": "null"}]}, "site_type_confidence": {"type": "number", "minimum": 0, "maximum": 1},
        "topics": {"type": "array", "maxItems": MOST_TOPICS, "items": {"type": "object", "required": ["tier1_id"], "properties": {"tier1_id": {"type": "string"}, "tier2_id": {"type": ["string", "null"]}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}}}},
        "audience_geo": {"type": ["string", "null"]}, "evidence": {"type": "string", "maxLength": EVIDENCE_CHARS}, "uncertain_because": {"type": ["string", "null"]},
    },
}


class Provider(Protocol):
    """A model: one JSON reply per prompt, or an error code."""

    def complete(self, system: str, user: str, model: str) -> dict: ...


REGISTRY: dict[str, Callable[..., Provider]] = {}


def register(name: str, factory: Callable[..., Provider]) -> None:
    """``factory`` takes base_url and api_key, of which it may ignore what it does not need."""
    REGISTRY[name] = factory


def provider(name: str | None, base_url: str = "", api_key: str = "") -> Callable[[], Provider] | None:
    """What makes the named provider on an executor; None for off."""
    if name in (None, "off"):
        return None
    if name not in REGISTRY:
        raise ValueError(f"unknown provider: {name}")
    return partial(REGISTRY[name], base_url=base_url, api_key=api_key)


def check_reply(reply: dict) -> dict:
    """A reply as a verdict row; what does not fit the contract is E_LLM_INVALID."""
    bad = {"error": "E_LLM_INVALID"}
    if reply.get("error"):
        return {"error": str(reply["error"])}
    c = reply.get("site_type_confidence")
    topics = reply.get("topics") or []
    if reply.get("site_type") not in (None, *SITE_TYPES) or not isinstance(c, (int, float)) or not 0 <= c <= 1 or not isinstance(topics, list) or len(topics) > MOST_TOPICS:
        return bad
    if any(not isinstance(t, dict) or not isinstance(t.get("tier1_id"), str) or not 0 <= float(t.get("confidence", 0)) <= 1 for t in topics):
        return bad
    if len(reply.get("evidence") or "") > EVIDENCE_CHARS:
        return bad
    return {
        "site_type": reply.get("site_type"), "site_type_confidence": float(c), "evidence": reply.get("evidence") or "", "audience_geo": reply.get("audience_geo"),
        "topics": [{"tier1_id": t["tier1_id"], "tier2_id": t.get("tier2_id"), "confidence": float(t.get("confidence", 0))} for t in topics],
        "uncertain_because": reply.get("uncertain_because"), "error": None, "tokens_in": reply.get("tokens_in"), "tokens_out": reply.get("tokens_out"),
    }


def ask(df: DataFrame, key: str, prompt: str, make: Callable[[], Provider], system: str, model: str, parallel: int = 8) -> DataFrame:
    """(key, verdict, model_id, prompt_sha256) from a provider, at most ``parallel`` calls at once; a failing
    row has an error."""
    kind = dict(df.dtypes)[key]
    names = [x.strip().split(" ")[0] for x in "site_type site_type_confidence topics audience_geo evidence uncertain_because error tokens_in tokens_out".split()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = make()
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[prompt]):
                try:
                    v = check_reply(p.complete(system, text, model))
                except Exception:  # noqa: BLE001 - isolate the row
                    v = {"error": "E_LLM_INVALID"}
                out.append({key: k, **{n: v.get(n) for n in names}})
            pdf = pd.DataFrame(out, columns=[key, *names])
            for c in ("tokens_in", "tokens_out"):
                pdf[c] = pdf[c].astype("Int32")
            yield pdf

    out = df.select(key, prompt).repartition(parallel).mapInPandas(run, f"{key} {kind}, {VERDICT}")
    return out.withColumns({"model_id": F.lit(model), "prompt_sha256": F.lit(prompt_hash(system))})


def accepts(site_type: Column, confidence: Column, least: float) -> Column:
    return site_type.isNotNull() & (F.coalesce(confidence, F.lit(0.0)) >= least)


def block_reason(f: dict[str, Column]) -> Column:
    return F.concat(F.lit("blocking flag: "), F.coalesce(*[F.when(f[n], F.lit(n)) for n in ("dead", "parked", "soft_404", "non_html")]))


def _outcome(df: DataFrame, key: str, method, human, *, why=None, site_type=None, confidence=0.0, carry: bool = False) -> DataFrame:
    as_col = lambda v, t=None: v if isinstance(v, Column) else F.lit(v) if t is None else F.lit(v).cast(t)
    carried = {c: F.col(c) if carry else F.lit(None).cast(t) for c, t in CARRIED.items()}
    if why is not None:
        carried["uncertain_because"] = as_col(why)
    return df.select(
        key, as_col(method).alias("method"), as_col(site_type, "string").alias("site_type"), as_col(confidence).cast("double").alias("confidence"),
        as_col(human).alias("needs_human"), *[v.alias(c) for c, v in carried.items()],
    )


def climb(pages: DataFrame, key: str, blocking: Column, reason: Column, small: Callable[[DataFrame], DataFrame] | None, large: Callable[[DataFrame], DataFrame] | None, least_small: float = ACCEPT_SMALL, least_large: float = ACCEPT_LARGE) -> DataFrame:
    """(key, method, site_type, confidence, needs_human and what a verdict carries) of every page.

    ``small`` and ``large`` turn a DataFrame of pages into (key, site_type, site_type_confidence, error) and
    any of the carried columns.  An outcome carries everything of the rung that it comes from."""
    stopped = _outcome(pages.where(blocking), key, "blocked", False, why=reason, confidence=1.0)
    rest = pages.where(~blocking)
    if small is None:
        return stopped.unionByName(_outcome(rest, key, "blocked", True, why=DISABLED))

    def rung(call: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
        v = call(df)
        return materialise(v.select(key, "site_type", "site_type_confidence", "error", *[F.col(c) if c in v.columns else F.lit(None).cast(t).alias(c) for c, t in CARRIED.items()]))

    s = rung(small, rest)
    taken = lambda df, method, human: _outcome(df, key, method, human, site_type=F.col("site_type"), confidence=F.col("site_type_confidence"), carry=True)
    ok = accepts(F.col("site_type"), F.col("site_type_confidence"), least_small)
    failed = _outcome(s.where("error IS NOT NULL"), key, "failed_classify", True, why=FAILED)
    first = taken(s.where(F.col("error").isNull() & ok), "llm_small", False)
    left = s.where(F.col("error").isNull() & ~ok)
    b = rung(large or small, rest.join(left.select(key), key, "left_semi"))
    # the large model failed: the small one's answer goes to a human
    back = taken(left.join(b.where("error IS NOT NULL").select(key), key, "left_semi"), "llm_small", True)
    second = taken(b.where("error IS NULL"), "llm_large", ~accepts(F.col("site_type"), F.col("site_type_confidence"), least_large))
    return stopped.unionByName(failed).unionByName(first).unionByName(back).unionByName(second)


class FakeProvider:
    """Deterministic replies for tests: the first needle found in the prompt answers."""

    def __init__(self, answers: list[tuple[str, dict]], default: dict | None = None):
        self.answers, self.default = answers, default or {"site_type": "other", "site_type_confidence": 0.5}

    def complete(self, system: str, user: str, model: str) -> dict:
        return next((a for needle, a in self.answers if needle in user), self.default)


def _post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    import urllib.request

    req = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(req, timeout=timeout) as r:
        return json.loads(r.read())


class LocalHttpProvider:
    """A model behind a local chat endpoint that answers by a schema; what does not fit it is sent back
    once with the request to mend it."""

    def __init__(self, base_url: str = "", api_key: str = "", timeout: float = 120.0):
        self.url, self.timeout = (base_url or "http://localhost:11434").rstrip("/") + "/api/chat", timeout

    def complete(self, system: str, user: str, model: str) -> dict:
        import urllib.error

        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        for shape in (REPLY_SCHEMA, "json"):
            try:
                got = _post(self.url, {"model": model, "stream": False, "format": shape, "options": {"temperature": 0, "num_ctx": 8192}, "messages": messages}, {}, self.timeout)
            except urllib.error.HTTPError:
                return {"error": "E_LLM_RATE"}
            except (OSError, ValueError):
                return {"error": "E_LLM_AUTH"}
            content = (got.get("message") or {}).get("content") or ""
            try:
                reply = json.loads(content)
                if isinstance(reply, dict) and not check_reply(reply).get("error"):
                    return {**reply, "tokens_in": got.get("prompt_eval_count"), "tokens_out": got.get("eval_count")}
            except (ValueError, TypeError, AttributeError):
                pass
            messages += [{"role": "assistant", "content": content}, {"role": "user", "content": "This does not fit the schema. Answer with the mended JSON object and nothing else."}]
        return {"error": "E_LLM_INVALID"}


class MessagesProvider:
    """A hosted model behind a messages endpoint: key in a header, the reply as JSON text."""

    def __init__(self, base_url: str = "", api_key: str = "", timeout: float = 120.0):
        self.url, self.key, self.timeout = base_url.rstrip("/") + "/v1/messages", api_key, timeout

    def complete(self, system: str, user: str, model: str) -> dict:
        import urllib.error

        body = {"model": model, "max_tokens": 1024, "system": f"{system}\n\nThe reply follows this JSON schema: {json.dumps(REPLY_SCHEMA)}", "messages": [{"role": "user", "content": user}]}
        try:
            got = _post(self.url, body, {"x-api-key": self.key}, self.timeout)
            usage = got.get("usage") or {}
            reply = json.loads("".join(x.get("text", "") for x in got["content"]))
            return {**reply, "tokens_in": usage.get("input_tokens"), "tokens_out": usage.get("output_tokens")}
        except urllib.error.HTTPError as e:
            return {"error": "E_LLM_AUTH" if e.code in (401, 403) else "E_LLM_RATE" if e.code in (429, 529) else "E_LLM_INVALID"}
        except OSError:
            return {"error": "E_LLM_AUTH"}
        except (ValueError, KeyError, TypeError):
            return {"error": "E_LLM_INVALID"}


register("local", LocalHttpProvider)
register("hosted", MessagesProvider)
