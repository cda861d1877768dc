"""A scorer that asks a chat-completions endpoint over HTTP, with the standard library only."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

from termloom.operators.scoring import Scoring


def reply_schema(s: Scoring) -> dict:
    """The JSON schema of a reply: one whole number for each field, within its codes."""
    fields = {k: {"type": "integer", "minimum": 0, "maximum": size - 1} for k, (_, size, _) in s.fields.items() if k in s.needed}
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


@dataclass(frozen=True)
class HttpScorer:
    """Sends a prompt and gives the text of the answer; picklable, so that workers can hold one.

    The answer's form is asked for as a JSON schema; an endpoint that refuses the
    form with status 400 is asked again for any JSON object. Other errors are
    raised with their status, and ``scoring.ask`` retries them.
    """

    settings: Scoring
    url: str
    key: str
    timeout: float = 60.0

    def _send(self, prompt: str, form: dict) -> str:
        system = [{"role": "system", "content": self.settings.prompt}] if self.settings.prompt else []
        body = {"model": self.settings.model, "temperature": 0, "messages": [*system, {"role": "user", "content": prompt}], "response_format": form}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = json.load(answer)
        text = found["choices"][0]["message"]["content"]
        if not text:
            raise ValueError("empty reply")
        return text

    def __call__(self, prompt: str) -> str:
        strict = {"type": "json_schema", "json_schema": {"name": "reply", "strict": True, "schema": reply_schema(self.settings)}}
        try:
            try:
                return self._send(prompt, strict)
            except urllib.error.HTTPError as e:
                if e.code != 400:
                    raise
                return self._send(prompt, {"type": "json_object"})
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"status {e.code}: {e.read(500).decode('utf-8', 'replace')}") from None
