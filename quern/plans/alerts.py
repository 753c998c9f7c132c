"""Alerts to a chat webhook, off unless the environment switches them on. A fault in telling is logged and goes no further."""

from __future__ import annotations

import json
import logging
import os
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

log = logging.getLogger("quern.alerts")

#: Environment variables and their values (fixed values).
ENABLED, CHANNEL, WEBHOOK, TIMEOUT = "ALERTS_ENABLED", "ALERTS_CHANNEL", "ALERTS_SLACK_WEBHOOK_URL", "ALERTS_TIMEOUT_SECONDS"
PROJECT, PLACE = "ALERTS_PROJECT", "ALERTS_ENVIRONMENT"
SEVERITIES = ("low", "medium", "high", "critical")
YES = ("1", "true", "yes", "y", "on")

#: What a scheduler's callback knows of a failed task: our name, and the keys and attributes that lead to it.
TASK_FACTS = {"dag_id": ("task_instance", "dag_id"), "task_id": ("task_instance", "task_id"), "run_id": ("dag_run", "run_id"), "try_number": ("task_instance", "try_number"), "error": ("exception",)}


@dataclass(frozen=True)
class Alert:
    title: str
    message: str
    severity: str = "high"
    facts: Mapping = field(default_factory=dict)

    def lines(self, source: str) -> list[str]:
        """A head line, the message, and a line for each fact that is known. Severities that don't exist count as high."""
        level = self.severity.lower() if self.severity.lower() in SEVERITIES else "high"
        return [f"{level.upper()} | {source} | {self.title}", self.message, *(f"{name} = {value}" for name, value in self.facts.items() if value is not None)]


def post_json(url: str, payload: dict, timeout: float) -> None:
    body = json.dumps(payload).encode()
    urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout).close()


@dataclass(frozen=True)
class Webhook:
    url: str
    source: str
    timeout: float = 5.0

    @classmethod
    def configured(cls, env: Mapping[str, str]) -> Webhook | None:
        """The webhook that the environment names; None where alerts are off. ValueError where they are on and cannot work."""
        said = {name: env.get(name, "").strip() for name in (ENABLED, CHANNEL, WEBHOOK, TIMEOUT, PROJECT, PLACE)}
        if said[ENABLED].lower() not in YES or said[CHANNEL].lower() in ("", "none"):
            return None
        if said[CHANNEL].lower() != "slack":
            raise ValueError(f"{CHANNEL} is {said[CHANNEL]}; only slack is known")
        if not said[WEBHOOK]:
            raise ValueError(f"{WEBHOOK} is not set")
        seconds = said[TIMEOUT].replace(".", "", 1)
        return cls(said[WEBHOOK], f"{said[PROJECT] or 'quern'}/{said[PLACE] or 'local'}", float(said[TIMEOUT]) if seconds.isdigit() else cls.timeout)

    def tell(self, alert: Alert, post: Callable = post_json) -> None:
        post(self.url, {"text": "\n".join(alert.lines(self.source))}, self.timeout)


def tell(alert: Alert, post: Callable = post_json, env: Mapping[str, str] | None = None) -> bool:
    """Whether the alert went out."""
    try:
        webhook = Webhook.configured(os.environ if env is None else env)
        if webhook:
            webhook.tell(alert, post)
    except Exception:
        log.exception("an alert was not sent: %s", alert.title)
        return False
    return webhook is not None


def task_failure(context: Mapping, post: Callable = post_json) -> bool:
    """A callback for schedulers that pass what they know of a failed task as a mapping."""

    def follow(value: object, step: str) -> object:
        return value.get(step) if isinstance(value, Mapping) else getattr(value, step, None)

    facts = {name: reduce(follow, way, context) for name, way in TASK_FACTS.items()}
    if facts["run_id"] is None:
        facts["run_id"] = context.get("run_id")
    if facts["error"] is not None:
        facts["error"] = f"{type(facts['error']).__name__}: {facts['error']}"
    return tell(Alert("Task failed", "A scheduled task did not finish.", facts=facts), post)
