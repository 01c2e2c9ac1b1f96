"""Pluggable models: text in, text out, called in Arrow batches with retries."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the prompts say round the fields of a unit, and what a second attempt adds.
SCREENING_TASK = "请只判断以下单个 text_unit 是否可能涉及标准、认证、管理体系、市场准入或标准符合性。"
EXTRACTION_TASK = "请分析以下年报 text_unit，只能根据给定 text 判断，并且只输出合法 JSON。"
RETRY_SUFFIX = "\n\n上一次输出未通过JSON结构或重复退化检查。\n请重新完成判断，只输出符合指定Schema的JSON。\n不要重复句子，不要输出解释文字。\nevidence中的英文双引号必须作为JSON字符串内容正确转义。"


class Provider(Protocol):
    """What a model must offer. It is pickled to the workers, and must open connections only when called."""

    def complete(self, system: str, user: str) -> str: ...


class BatchProvider(Protocol):
    """A model that takes many prompts at once, such as an engine that lives in the worker: replies in the order of the prompts."""

    chunk: int

    def complete_batch(self, system: str, users: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class StubProvider:
    """A deterministic model for tests and dry runs: reply(system, user), or a hash of the input."""

    reply: Callable[[str, str], str] | None = None

    def complete(self, system: str, user: str) -> str:
        return self.reply(system, user) if self.reply else hashlib.sha256(f"{system}\0{user}".encode()).hexdigest()


@dataclass(frozen=True)
class HttpProvider:
    """A chat-completions endpoint."""

    base_url: str
    model: str
    api_key: str
    timeout: int = 300
    temperature: float = 0.0
    json_object: bool = True
    max_tokens: int | None = None
    extra_body: dict | None = None

    def body(self, system: str, user: str) -> dict:
        body: dict = {"model": self.model, "temperature": self.temperature, "messages": messages(system, user)}
        if self.json_object:
            body["response_format"] = {"type": "json_object"}
        if self.max_tokens:
            body["max_tokens"] = self.max_tokens
        return body | (self.extra_body or {})

    def complete(self, system: str, user: str) -> str:
        request = urllib.request.Request(self.base_url.rstrip("/") + "/chat/completions", json.dumps(self.body(system, user)).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]


def messages(system: str, user: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def chat_text(tokenizer: Any, system: str, user: str) -> str:
    """The prompt in the model's own chat form, without its thinking where that can be switched off; a plain form for models without one."""
    for options in ({"enable_thinking": False}, {}):
        try:
            return tokenizer.apply_chat_template(messages(system, user), tokenize=False, add_generation_prompt=True, **options)
        except TypeError:
            continue
        except Exception:  # noqa: BLE001  a tokenizer without a template
            break
    return f"System:\n{system}\n\nUser:\n{user}\n\nAssistant:\n"


#: Engines that this worker has built; a model is loaded once for all its tasks.
_ENGINES: dict[str, Any] = {}


def _engine(settings: Any, build: Callable[[], Any]) -> Any:
    key = repr(settings)
    if key not in _ENGINES:
        _ENGINES[key] = build()
    return _ENGINES[key]


@dataclass(frozen=True)
class EngineProvider:
    """A batch engine that lives in the worker (vllm, if it is installed): built once, given chunks of prompts, with structured output."""

    model_path: str
    chunk: int = 64
    dtype: str = "auto"
    trust_remote_code: bool = True
    tensor_parallel_size: int = 1
    gpu_memory_utilization: float = 0.90
    max_model_len: int = 4096
    temperature: float = 0.0
    max_tokens: int = 384
    enforce_eager: bool = False
    enable_lora: bool = False
    lora_path: str | None = None
    lora_rank: int = 32
    structured_output: dict | None = None

    def __post_init__(self) -> None:
        if self.chunk <= 0:
            raise ValueError("chunk must be greater than 0")

    def engine_options(self) -> dict:
        options = {"model": self.model_path, **{k: getattr(self, k) for k in ("dtype", "trust_remote_code", "tensor_parallel_size", "gpu_memory_utilization", "max_model_len", "enforce_eager", "enable_lora")}}
        return options | ({"max_lora_rank": self.lora_rank} if self.enable_lora else {})

    def _build(self) -> tuple:
        import vllm

        return vllm, vllm.LLM(**self.engine_options())

    def complete_batch(self, system: str, users: list[str]) -> list[str]:
        vllm, engine = _engine(self, self._build)
        tokenizer = engine.get_tokenizer()
        options: dict = {"temperature": self.temperature, "max_tokens": self.max_tokens}
        if self.structured_output:
            options |= structured_options(vllm, self.structured_output)
        lora = {}
        if self.enable_lora and self.lora_path:
            from vllm.lora.request import LoRARequest

            lora = {"lora_request": LoRARequest("adapter", 1, self.lora_path)}
        out = engine.generate([chat_text(tokenizer, system, u) for u in users], vllm.SamplingParams(**options), use_tqdm=False, **lora)
        return [o.outputs[0].text.strip() if o.outputs else "" for o in out]


def structured_options(vllm: Any, schema: dict) -> dict:
    """How the installed version of the engine takes a JSON schema; nothing if it takes none."""
    known = getattr(vllm, "sampling_params", vllm)
    for cls, option in (("StructuredOutputsParams", "structured_outputs"), ("GuidedDecodingParams", "guided_decoding")):
        if hasattr(known, cls):
            return {option: getattr(known, cls)(json=schema)}
    return {}


@dataclass(frozen=True)
class LocalProvider:
    """A model that the worker loads by itself (transformers, if it is installed), one prompt at a time."""

    model_path: str
    device_map: str = "auto"
    torch_dtype: str = "auto"
    max_new_tokens: int = 1024
    max_input_chars: int | None = None
    load_in_4bit: bool = False

    def _build(self) -> tuple:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        options: dict = {"device_map": self.device_map, "torch_dtype": self.torch_dtype, "trust_remote_code": True}
        if self.load_in_4bit:
            from transformers import BitsAndBytesConfig

            wide = torch.float16 if torch.cuda.is_available() and not torch.cuda.is_bf16_supported() else torch.bfloat16
            options["quantization_config"] = BitsAndBytesConfig(load_in_4bit=True, bnb_4bit_compute_dtype=wide, bnb_4bit_quant_type="nf4", bnb_4bit_use_double_quant=True)
        tokenizer = AutoTokenizer.from_pretrained(self.model_path, trust_remote_code=True)
        return torch, tokenizer, AutoModelForCausalLM.from_pretrained(self.model_path, **options).eval()

    def complete(self, system: str, user: str) -> str:
        torch, tokenizer, model = _engine(self, self._build)
        text = chat_text(tokenizer, system, user[: self.max_input_chars] if self.max_input_chars else user)
        given = tokenizer(text, return_tensors="pt").to(model.device)
        with torch.inference_mode():
            out = model.generate(**given, max_new_tokens=self.max_new_tokens, do_sample=False, pad_token_id=tokenizer.pad_token_id or tokenizer.eos_token_id)
        return tokenizer.decode(out[0][given["input_ids"].shape[-1] :], skip_special_tokens=True).strip()


@dataclass(frozen=True)
class Retry:
    """Attempts and the bounds of the exponential pause between them, in seconds."""

    attempts: int = 3
    least: float = 2.0
    most: float = 10.0

    def pause(self, attempt: int) -> float:
        return min(self.most, self.least * 2 ** (attempt - 1))


def call_model(df: DataFrame, system: str, user: str, provider: Provider | BatchProvider, retry: Retry = Retry(), partitions: int | None = None) -> DataFrame:
    """df with raw (the reply, null if all attempts failed), attempts and call_error.

    ``user`` names the column of prompts. A batch provider gets chunks of prompts and isn't asked again. partitions bounds the calls made at once. A recomputed task calls again, so
    write the result before using it twice.
    """
    names = df.columns

    def in_chunks(prompts: list[str]) -> list[tuple]:
        """A chunk that raises, and prompts without a reply, are errors of those rows only; nothing is lost."""
        rows: list[tuple] = []
        for i in range(0, len(prompts), provider.chunk):
            part = prompts[i : i + provider.chunk]
            try:
                replies = list(provider.complete_batch(system, part))
                rows += [(r, 1, None) for r in replies[: len(part)]] + [(None, 1, "no reply")] * (len(part) - len(replies))
            except Exception as e:  # noqa: BLE001
                rows += [(None, 1, f"{type(e).__name__}: {e}")] * len(part)
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = in_chunks([p or "" for p in pdf[user]]) if hasattr(provider, "complete_batch") else []
            for prompt in pdf[user] if not rows else ():
                error = None
                for attempt in range(1, retry.attempts + 1):
                    try:
                        rows.append((provider.complete(system, prompt or ""), attempt, None))
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        if attempt < retry.attempts:
                            time.sleep(retry.pause(attempt))
                else:
                    rows.append((None, retry.attempts, error))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["raw", "attempts", "call_error"], dtype=object)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", raw string, attempts int, call_error string"
    if partitions:
        df = df.repartition(partitions)
    return df.mapInPandas(run, schema).select(*names, "raw", "attempts", "call_error")


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _field(name: str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit("")))


def screening_prompt() -> Column:
    """The user part of a relevance prompt: task, id and text."""
    return _lines(SCREENING_TASK, _field("text_unit_id"), "text:", "---", F.coalesce("text", F.lit("")), "---")


def extraction_prompt() -> Column:
    """The user part of an extraction prompt: task, id, firm, year and text."""
    return _lines(EXTRACTION_TASK, *[_field(c) for c in ("text_unit_id", "stock_code", "company_name", "year")], "text:", "---", F.coalesce("text", F.lit("")), "---")
