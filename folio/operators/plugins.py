"""Rankers of sections and answerers: the two places where a model may be asked, each a function of its own. replies.asked() asks them."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from folio.errors import ModelError

#: Takes a prompt, gives the reply or None.
NodeRanker = Callable[[str], str | None]
#: Takes a prompt and base64 images, gives the answer or None.
Answerer = Callable[[str, list[str]], str | None]
#: Seconds that a ranker may take for a prompt, and an answerer.
TIMEOUT, ANSWER_TIMEOUT = 15.0, 120.0


class ChatClient:
    """A chat model behind HTTP: POST /api/chat, one reply, no stream."""

    def __init__(self, base_url: str, model: str, timeout: float = 120.0) -> None:
        self.base_url, self.model, self.timeout = base_url.rstrip("/"), model, timeout

    def chat(self, messages: list[dict], model: str | None = None, form: str | None = None, **options: object) -> str:
        """The reply's text, from message.content or response; ModelError if it has neither. form "json" asks for JSON. Errors of HTTP pass through."""
        body = {"model": model or self.model, "messages": messages, "temperature": 0.0, "stream": False} | ({"options": options} if options else {}) | ({"format": form} if form else {})
        request = urllib.request.Request(f"{self.base_url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as got:
            reply = json.load(got)
        told = (reply.get("message") or {}).get("content") if isinstance(reply, dict) else None
        told = reply.get("response") if told is None and isinstance(reply, dict) else told
        if told is None:
            raise ModelError("the reply holds no text")
        return told

    def is_available(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.base_url}/api/tags", timeout=self.timeout) as got:
                return got.status == 200
        except OSError:
            return False

    def ranker(self) -> NodeRanker:
        return lambda prompt: self.chat([{"role": "user", "content": prompt}], form="json", num_ctx=2048, num_predict=256).strip()

    def answerer(self) -> Answerer:
        return lambda prompt, images: self.chat([{"role": "user", "content": prompt} | ({"images": images} if images else {})], num_ctx=2048, num_predict=256)
