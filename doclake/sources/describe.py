"""A client for services that describe images by the usual chat-completions interface, and a probe that tells whether one answers."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from doclake.config import CaptionSettings

PROMPT = "Describe this image in one or two plain sentences, in the language of any text that it shows."
#: (address, headers, body, seconds) to the answer's text; raises for anything but success.
Post = Callable[[str, dict[str, str], bytes, float], str]


def _post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as got:  # noqa: S310
        return got.read(1 << 20).decode("utf-8", "replace")


def _ask(settings: CaptionSettings, content: object, tokens: int, post: Post) -> str:
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {settings.sent_key()}"}
    body = {"model": settings.model, "messages": [{"role": "user", "content": content}], "max_tokens": tokens}
    answer = json.loads(post(f"{settings.base_url.rstrip('/')}/chat/completions", headers, json.dumps(body).encode(), settings.timeout))
    said = answer["choices"][0]["message"].get("content")
    return (said or "").strip()


def describer(settings: CaptionSettings, post: Post = _post) -> Callable[[str], str]:
    """A function from an image's address, or data address, to its description; workers call it, and what it raises they tell.

    Images are named to the service by their addresses; those in files of this machine must be made data addresses before.
    """

    def describe(url: str) -> str:
        return _ask(settings, [{"type": "text", "text": settings.prompt or PROMPT}, {"type": "image_url", "image_url": {"url": url}}], 300, post)

    return describe


def probe(settings: CaptionSettings, post: Post = _post) -> tuple[bool, str]:
    """Whether the service answers a short question, and what it said, or what is wrong."""
    if not settings.usable():
        return False, "the service's address, key or model is missing"
    try:
        said = _ask(settings, "Answer with the single word: ready", 10, post)
    except Exception as e:  # noqa: BLE001
        return False, f"{type(e).__name__}: {e}"
    return bool(said), said or "the answer is empty"
