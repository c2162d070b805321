"""A text model behind a messages API: settings, request body, and the text of the answer.

``send`` takes (model id, request body as JSON) and returns the answer as JSON text.  It is given by the
caller (tests, other transports), or made from the public AWS SDK the first time that it is needed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

Send = Callable[[str, str], str]
#: The body's version entry (fixed values of the format).
VERSION_KEY, VERSION = "anthropic_version", "bedrock-2023-05-31"


@dataclass(frozen=True)
class ModelSettings:
    model_id: str
    region: str
    max_tokens: int = 4096
    temperature: float = 0.0
    timeout_seconds: int = 60


def request_body(settings: ModelSettings, prompt: str, system: str | None = None) -> dict[str, Any]:
    body: dict[str, Any] = {VERSION_KEY: VERSION, "max_tokens": settings.max_tokens, "temperature": settings.temperature, "messages": [{"role": "user", "content": prompt}]}
    return body | ({"system": system} if system else {})


def answer_text(answer: str) -> str:
    """The text parts of an answer, one behind the other."""
    return "".join(part.get("text", "") for part in json.loads(answer).get("content", []) if part.get("type") == "text")


def sdk_sender(settings: ModelSettings) -> Send:
    import boto3
    from botocore.config import Config

    client = boto3.client("bedrock-runtime", region_name=settings.region, config=Config(read_timeout=settings.timeout_seconds))

    def send(model_id: str, body: str) -> str:
        return client.invoke_model(modelId=model_id, body=body, contentType="application/json", accept="application/json")["body"].read()

    return send


@dataclass
class ModelClient:
    settings: ModelSettings
    send: Send | None = None
    _made: list[Send] = field(default_factory=list, repr=False)

    def invoke(self, prompt: str, *, system: str | None = None) -> str:
        send = self.send
        if send is None:
            if not self._made:
                self._made.append(sdk_sender(self.settings))
            send = self._made[0]
        return answer_text(send(self.settings.model_id, json.dumps(request_body(self.settings, prompt, system))))
