"""Adapters from chat services to the model clients of ``extract``; a service is any callable, so no vendor's library is needed.

A call that fails raises, and ``extract.ask`` turns that into a row with an error.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

JSON_ORDER = "Answer with one valid JSON object and nothing else."


def image_url(image: bytes, kind: str = "image/png") -> str:
    return f"data:{kind};base64," + base64.b64encode(image).decode()


def from_data_url(url: str) -> tuple[str, bytes]:
    """(type, bytes) of a data URL in base64."""
    head, sep, body = url.partition(",")
    if not sep or not head.startswith("data:") or not head.endswith(";base64"):
        raise ValueError("not a data URL in base64")
    return head[5:-7], base64.b64decode(body, validate=True)


def user_message(prompt: str, images: list[bytes] | tuple[bytes, ...] = ()) -> dict:
    if not images:
        return {"role": "user", "content": prompt}
    return {"role": "user", "content": [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": image_url(i)}} for i in images)]}


def in_json_mode(messages: list[dict]) -> list[dict]:
    """The messages with the order to answer in JSON as their system message, in place of one that leads them."""
    rest = messages[1:] if messages and messages[0]["role"] == "system" else messages
    return [{"role": "system", "content": JSON_ORDER}, *rest]


class ChatClient:
    """A service that takes messages: ``send(messages, temperature)`` gives the reply's text or null."""

    def __init__(self, send: Callable[[list[dict], float], str | None], json_mode: bool = False):
        self.send, self.json_mode = send, json_mode

    def chat(self, messages: list[dict], temperature: float = 0.1) -> str | None:
        return self.send(in_json_mode(messages) if self.json_mode else messages, temperature)

    def complete(self, prompt: str, temperature: float = 0.1, images: list[bytes] | tuple[bytes, ...] = ()) -> str | None:
        return self.chat([user_message(prompt, images)], temperature)


class Blocked(Exception):
    """A service refused to answer for safety."""


class PartsClient:
    """A service that takes parts, texts and ``(type, bytes)``: ``send(parts, temperature, mime_type)``; a blocked reply is an empty text."""

    def __init__(self, send: Callable[[list[str | tuple[str, bytes]], float, str], str | None], json_mode: bool = False):
        self.send, self.mime = send, "application/json" if json_mode else "text/plain"

    def chat(self, messages: list[dict], temperature: float = 0.1) -> str | None:
        parts: list[str | tuple[str, bytes]] = []
        for m in messages:
            content = m["content"] if isinstance(m["content"], list) else [{"type": "text", "text": m["content"]}]
            parts += [p["text"] if p["type"] == "text" else from_data_url(p["image_url"]["url"]) for p in content]
        try:
            return self.send(parts, temperature, self.mime)
        except Blocked:
            return ""

    def complete(self, prompt: str, temperature: float = 0.1, images: list[bytes] | tuple[bytes, ...] = ()) -> str | None:
        return self.chat([user_message(prompt, images)], temperature)
