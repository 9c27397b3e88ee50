"""Phrases that speak to a machine in place of a reader, as flags for a person to look at. Nothing acts on them.

A family is data: alternatives, each a sequence of sets of words with the most characters that may lie between. They are compiled into
patterns over folded text: compatibility form, without format characters, white space squeezed. A text is looked at for a family only if one pass
of a common pattern finds a word that the family cannot do without. Null and empty texts have no flags.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words of the phrases, by what they do in them
DROP = ("ignore", "disregard", "forget", "override", "bypass")
EARLIER = ("previous", "prior", "above", "earlier", "preceding", "all", "any", "your", "system")
ORDERS = ("instruction", "instructions", "prompt", "prompts", "direction", "directions", "rules", "guidelines", "context")
MODELS = ("ai", "a.i.", "artificial intelligence", "ai assistant", "assistant", "chatbot", "language model", "large language model", "llm", "chatgpt", "gpt", "claude", "gemini", "copilot", "perplexity")
ROLES = ("ai assistant", "ai model", "ai language model", "language model", "large language model", "llm")
CALLS = ("dear", "attention", "note to", "hey", "hello")
CALLED = ("ai", "a.i.", "llm", "llms", "ai assistant", "ai assistants", "chatbot", "chatbots", "chatgpt", "claude", "gemini", "language model", "language models", "ai model", "ai models", "ai agent", "ai agents", "ai crawler", "ai crawlers", "ai system", "ai systems")
GROUPS = ("ai", "llm", "llms", "ai assistant", "ai assistants", "chatbot", "chatbots", "language model", "language models", "ai model", "ai models", "ai agent", "ai agents", "ai system", "ai systems")
MUST = ("must", "should", "shall", "always", "never", "are required to")
ACTS = ("recommend", "say", "answer", "cite", "mention", "rank", "respond", "reply", "tell", "describe", "state", "prefer", "output")
KO_EARLIER, KO_ORDERS, KO_DROP = ("이전", "위", "앞", "기존", "모든"), ("지시", "지침", "명령", "프롬프트", "규칙"), ("무시", "잊")
KO_YOU, KO_MODELS = ("너는", "넌", "당신은", "그대는"), ("AI", "에이아이", "인공지능", "인공 지능", "어시스턴트", "챗봇", "언어 모델", "언어모델")
KO_ACTS, KO_MUST = ("추천", "답변", "대답", "말", "인용", "언급"), ("해야", "하라", "하세요", "해라", "할 것", "할것")


def _any(words: tuple[str, ...], whole: bool = True) -> str:
    body = "|".join(re.escape(w).replace(r"\ ", r"\s*" if ord(w[0]) > 0x1000 else r"\s+") for w in sorted(words, key=len, reverse=True))
    return rf"(?<!\w)(?:{body})(?!\w)" if whole else f"(?:{body})"


def _gap(most: int) -> str:
    """At most so many characters of one sentence."""
    return rf"[^.\n]{{0,{most}}}?"


#: Family: (what it cannot do without, patterns).
FAMILIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ignore_instructions": (_any(DROP), (_any(DROP) + _gap(40) + _any(EARLIER) + _gap(20) + _any(ORDERS),)),
    "addressed_to_ai": (
        _any(("you are", "you're", "as an", "as a", *CALLS)),
        (_any(("you are", "you're")) + r"\s+(?:now\s+)?(?:an?\s+)?" + _any(MODELS), _any(("as a", "as an")) + r"\s+" + _any(ROLES), _any(CALLS) + r"\s*,?\s*(?:all\s+)?" + _any(CALLED)),
    ),
    "ai_directive": (_any(MUST), (_any(GROUPS) + _gap(30) + _any(MUST) + _gap(40) + r"(?<!\w)" + _any(ACTS, whole=False),)),
    "system_prompt": (r"system|inst|im_start|시스템", (_any(("system prompt", "system message", "system instruction", "system instructions")), r"(?<!\w)new\s+instructions?\s*:", r"\[\s*(?:system|inst)\s*\]", r"<\|?\s*im_start", r"시스템\s*프롬프트")),
    "ignore_instructions_ko": (_any(KO_DROP, whole=False), (_any(KO_EARLIER, whole=False) + r"\S{0,3}\s*(?:\S+\s+){0,2}?" + _any(KO_ORDERS, whole=False) + r"\S{0,4}\s*(?:모두\s*)?" + _any(KO_DROP, whole=False),)),
    "addressed_to_ai_ko": (
        _any((*KO_YOU, *KO_MODELS), whole=False),
        (_any(KO_YOU, whole=False) + r"\s*(?:이제\s*)?" + _any(KO_MODELS, whole=False), _any(KO_MODELS, whole=False) + r"\S{0,3}\s*(?:에게|는|은)" + _gap(30) + _any(KO_ACTS, whole=False) + r"\S{0,2}\s*" + _any(KO_MUST, whole=False)),
    ),
}
_NEEDS = re.compile("|".join(f"(?:{need})" for need, _ in FAMILIES.values()), re.I)
_COMPILED = {name: (re.compile(need, re.I), [re.compile(p, re.I) for p in patterns]) for name, (need, patterns) in FAMILIES.items()}


def folded(text: str) -> str:
    plain = unicodedata.normalize("NFKC", text)
    if not plain.isascii():
        plain = "".join(c for c in plain if unicodedata.category(c) != "Cf")
    return " ".join(plain.split())


def families(text: str | None) -> list[str]:
    """The families that a text has a phrase of, in their order."""
    plain = folded(text or "")
    if not _NEEDS.search(plain):
        return []
    return [name for name, (need, patterns) in _COMPILED.items() if need.search(plain) and any(p.search(plain) for p in patterns)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def instruction_families(x: pd.Series) -> pd.Series:
    return x.map(families)
