"""A language model behind an OpenAI-compatible endpoint, as a function from prompt to reply.

Only the judge of borderline pages and the navigation analysis use it, both pluggable; a
missing key means there is no model, and the engine decides by its rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from ..model import LLMConfig

JUDGE = (
    "You check Markdown that was extracted from a documentation page. Fail it if it is only navigation, cut off, the wrong part of the page, "
    'broken in structure, mostly links, or garbled; pass it otherwise. Reply with JSON only: {"passed": true or false, "score": 0 to 1, "reason": "..."}'
)
NAVIGATION = (
    "You read the HTML of a site's navigation and return its tree, at most three levels deep, as JSON only: "
    '{"sections": [{"title": "...", "url": "...", "priority": "core" or "secondary", "children": []}]}. Guides and references are core; news, legal and changelog pages are secondary.'
)

#: Sends (url, headers, body, seconds) and returns the reply's body.
Post = Callable[[str, dict[str, str], bytes, float], bytes]


def urllib_post(url: str, headers: dict[str, str], body: bytes, seconds: float) -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, data=body, headers=headers, method="POST"), timeout=seconds) as r:
        return r.read()


def chat(config: LLMConfig, system: str = JUDGE, max_tokens: int | None = None, post: Post = urllib_post) -> Callable[[str], str] | None:
    """A function from prompt to reply, or None without a key. Errors are the caller's to handle; keys are never logged."""
    key = config.key()
    if not key:
        return None

    def ask(prompt: str) -> str:
        body = {"model": config.model, "temperature": config.temperature, "max_tokens": max_tokens or config.max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        raw = post(config.base_url.rstrip("/") + "/chat/completions", {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, json.dumps(body).encode(), config.timeout)
        return (json.loads(raw)["choices"][0]["message"]["content"] or "").strip()

    return ask
