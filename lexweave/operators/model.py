"""Model calls as a map over partitions: an injectable client, retries, throttling, and the rules around a reply."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip_markdown, word_count
from ..session import ship_package

#: Sampling temperatures and the most tokens of a reply.
TEMPERATURE = {"translate": 0.5, "proofread": 0.6}
MAX_TOKENS, ATTEMPTS, LONGEST, LOW_ADEQUACY = 4096, 5, 1000, 25
#: Provider presets (address, default model, variable that holds the key).
PROVIDERS = {
    "openai": ("https://api.openai.com/v1", "gpt-4o", "OPENAI_API_KEY"),
    "mistral": ("https://api.mistral.ai/v1", "mistral-large-latest", "MISTRAL_API_KEY"),
    "deepseek": ("https://api.deepseek.com/v1", "deepseek-chat", "DEEPSEEK_API_KEY"),
    "together": ("https://api.together.xyz/v1", "openai/gpt-oss-20b", "TOGETHER_API_KEY"),
    "openrouter": ("https://openrouter.ai/api/v1", "openai/gpt-4o", "OPENROUTER_API_KEY"),
    "ollama": ("http://localhost:11434/v1", "gemma3n:e4b", ""),
    "lmstudio": ("http://localhost:1234/v1", "qwen2.5-72b", ""),
}


class StubClient:
    """Deterministic stand-in: answers the last message with its text, marked, in the wanted tags."""

    def __init__(self, mark: str = "[t] "):
        self.mark = mark

    def complete(self, payload: dict) -> str:
        tag = payload["target_tag"]
        text = re.sub(r"\A<[^>]*>|</[^>]*>\Z", "", payload["messages"][-1]["content"])
        return f"<{tag}>{self.mark}{text}</{tag}>"


class HttpClient:
    """Chat completions over http; `provider@model` asks for one provider of a model. Errors raise."""

    def __init__(self, url: str, key: str = "", timeout: float = 300.0):
        self.url, self.key, self.timeout = url.rstrip("/"), key, timeout

    def complete(self, payload: dict) -> str:
        body = {k: v for k, v in payload.items() if k != "target_tag"}
        provider, at, model = body["model"].rpartition("@")
        body["model"] = model
        if at:
            body["provider"] = {"order": [provider]}
        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        with urllib.request.urlopen(urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), head), timeout=self.timeout) as r:
            return reply_content(r.read().decode())


def reply_content(text: str) -> str:
    """choices[0].message.content of a reply; ValueError with the reply's own error where it has none."""
    data = json.loads(text)
    try:
        return data["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError(f"no content in the reply: {data.get('error', data) if isinstance(data, dict) else data}") from e


def unwrap(reply: str, tag: str) -> str | None:
    """Text in the wanted tags, without a model's thoughts; None where the tags are missing."""
    t = re.sub(r"(?is)<think\b[^>]*>.*?</think>", "", reply)
    m = re.search(rf"(?is)<{re.escape(tag)}>(.*?)</{re.escape(tag)}>", t)
    return m.group(1).strip() if m else None


def similarity(a: str, b: str) -> float:
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x and y else 0.0


def bleeds(source: str, target: str, context: list[tuple[str, str]]) -> bool:
    """As functions.quality.bleeding, for one reply at a time."""
    n, m = len(source.split()), len(target.split())
    return (n > 50 and m < 0.3 * n) or any(similarity(target, t) > 0.8 and similarity(source, s) < 0.3 for s, t in context)


@dataclass
class Caller:
    """One client of a partition: asks, retries with doubling pauses, keeps a least time between requests."""

    client: object
    model: str = "stub"
    kind: str = "translate"
    min_interval: float = 0.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: float = field(default=-1e9)

    def ask(self, messages: list[dict], tag: str) -> str | None:
        wait = self.last + self.min_interval - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.last = self.clock()
        reply = self.client.complete({"model": self.model, "messages": messages, "temperature": TEMPERATURE[self.kind], "max_tokens": MAX_TOKENS, "target_tag": tag})
        return unwrap(reply, tag)

    def translate(self, source: str, messages: Callable[[list], list[dict]], context: list[tuple[str, str]], tag: str) -> str:
        """The reply to a text. Without the tags it is asked once more without context, then given up as ''. After an
        error, or a reply that bleeds from the context, it is asked again: the context is cut to its last two pairs,
        then to none, and stays cut."""
        pairs, best = list(context), ""
        for attempt in range(ATTEMPTS):
            try:
                got = self.ask(messages(pairs), tag)
                if got is None:
                    got = self.ask(messages([]), tag)
                best = got or ""
                if not best or not bleeds(source, best, pairs):
                    return best
                pairs = pairs[-2:] if len(pairs) > 2 else []
            except Exception:  # noqa: BLE001 - any failure of the service is tried again
                if attempt == ATTEMPTS - 1:
                    raise
                self.sleep(2.0 ** (attempt + 1))
        return best


def exchange(r, pairs: list[tuple[str, str]], system: str) -> list[dict]:
    """Messages of a request: system prompt, similar example if the row has one, pairs, and the text itself."""
    s_tag, t_tag = (r.source_lang or "").lower(), (r.target_lang or "").lower()
    m = [{"role": "system", "content": system.format(source_lang=r.source_lang, target_lang=r.target_lang)}]
    similar = [(r.example["source"], r.example["target"])] if r.example is not None else []
    for s, t in [*similar, *pairs]:
        m += [{"role": "user", "content": f"<{s_tag}>{s}</{s_tag}>"}, {"role": "assistant", "content": f"<{t_tag}>{t}</{t_tag}>"}]
    return [*m, {"role": "user", "content": f"<{s_tag}>{r.clean}</{s_tag}>"}]


def answer(caller: Caller, r, pairs: list[tuple[str, str]], system: str) -> tuple[str, str, int]:
    """Reply to the clean text, reply with its marks put back, and milliseconds; a text of marks only is not sent."""
    began = time.monotonic()
    text = caller.translate(r.clean, lambda p: exchange(r, p, system), pairs, (r.target_lang or "").lower()) if r.clean else ""
    return text, f"{r.prefix}{text}{r.suffix}" if text or not r.clean else "", int((time.monotonic() - began) * 1000)


def model_text(rows: DataFrame, client_factory: Callable[[], object], system: str, kind: str = "translate", model: str = "stub", min_interval: float = 0.0, parallel: int | None = None) -> DataFrame:
    """rows: source, source_lang, target_lang, context (array of struct source, target), example (struct source, target;
    may be lacking), any others. The example stands before the context and stays when that is cut. Adds reply and duration (ms). Equal requests are sent once: they are collapsed first and joined back.

    parallel: so many partitions, and so many requests at a time, at most; the throttle is each partition's own."""
    ship_package(rows.sparkSession)
    if "example" not in rows.columns:
        rows = rows.withColumn("example", F.lit(None).cast("struct<source:string,target:string>"))
    ask = ["source", "source_lang", "target_lang", "context", "example"]
    keyed = rows.withColumn("_req", F.sha2(F.to_json(F.struct(*ask)), 256))
    unique = keyed.groupBy("_req").agg(*[F.first(c).alias(c) for c in ask])
    unique = unique.withColumn("_m", strip_markdown(F.col("source"))).select("_req", "source_lang", "target_lang", "context", "example", "_m.*")
    if parallel:
        unique = unique.repartition(parallel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(client_factory(), model, kind, min_interval)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                context = [(c["source"], c["target"]) for c in (r.context if r.context is not None else [])]
                _, text, took = answer(caller, r, context, system)
                out.append((r[0], text, took))
            yield pd.DataFrame(out, columns=["_req", "reply", "duration"])

    return keyed.join(unique.mapInPandas(run, "_req string, reply string, duration int"), "_req").drop("_req")


def fits(pairs: list[tuple[str, str]], limit: int) -> list[tuple[str, str]]:
    """As context.within_budget, for one list."""
    used, n = 0, len(pairs)
    for s, t in reversed(pairs):
        used += len(s.split()) + len(t.split())
        if used > limit:
            break
        n -= 1
    return pairs[n:]


def admissible(source: str, target: str) -> bool:
    """As context.admissible, for one pair."""
    n = len(source.split())
    return bool(n and target.split()) and (n <= 5 or similarity(source, target) <= 0.95)


def model_text_in_order(rows: DataFrame, group: list[str], order: list[str], client_factory: Callable[[], object], system: str, model: str = "stub", min_interval: float = 0.0, size: int = 5, limit: int = 512) -> DataFrame:
    """Replies of one run over each group in order, each request with the pairs before it, stored ones and this run's own
    replies alike: id, reply, duration. rows: id, group and order columns, source_lang, target_lang, source, target,
    example, ask (whether the row is to be asked for; the others only give context). A group is one task by nature, as a
    reply needs those before it; its rows stream through and only `size` pairs are kept. A task that runs again asks again."""
    ship_package(rows.sparkSession)
    marks = rows.withColumn("_m", strip_markdown(F.col("source"))).select(*dict.fromkeys(["id", *group, *order, "source_lang", "target_lang", "target", "example", "ask"]), "_m.*")
    ordered = marks.repartition(*group).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(client_factory(), model, "translate", min_interval)
        last, pairs = None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                now = tuple(None if pd.isna(x) else x for x in (getattr(r, g) for g in group))
                if now != last:
                    last, pairs = now, []
                target = r.target or ""
                if r.ask:
                    target, text, took = answer(caller, r, fits(pairs, limit), system)
                    out.append((r.id, text, took))
                if target and admissible(r.clean, target):
                    pairs = [*pairs, (r.clean, target)][-size:]
            yield pd.DataFrame(out, columns=["id", "reply", "duration"])

    return ordered.mapInPandas(run, "id long, reply string, duration int")


def better_of(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Where a first reply scored too low and was asked again, the second if it scores strictly higher."""
    b = second.select(*keys, F.col("reply").alias("_r"), F.col("adequacy").alias("_a"))
    j = first.join(b, keys, "left")
    take = F.coalesce(F.col("_a") > F.col("adequacy"), F.lit(False))
    return j.withColumn("reply", F.when(take, F.col("_r")).otherwise(F.col("reply"))).withColumn("adequacy", F.when(take, F.col("_a")).otherwise(F.col("adequacy"))).drop("_r", "_a")


def translatable(rows: DataFrame) -> DataFrame:
    """Rows worth a call: not blank, under LONGEST words."""
    return rows.filter((word_count(F.col("source")) > 0) & (word_count(F.col("source")) < LONGEST))


def changed(old, new):
    """Whether a proofread text differs from what it was made of, layout aside."""
    return squeeze(old) != squeeze(new)
