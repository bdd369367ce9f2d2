"""Simulated talks: what to do with a reply of a user model, whole talks, requests spread over endpoints, judge and annotator.

Models are functions of the caller; nothing here loads one. Rules are state machines without clocks or threads, so
that they can be tested; ``assistant_turn`` and ``many`` add the waiting and the concurrency.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

Talk = list[dict[str, str]]

# Parts of a service's message that speak of a full context.
CONTEXT_SIGNS = ("maximum context length", "max_model_len", "context length", "too long", "reduce the length")


class Refused(Exception):
    """The service says that this request can never succeed (a client error)."""


def refusal(error: Exception) -> str:
    return "context_limit" if any(sign in str(error).lower() for sign in CONTEXT_SIGNS) else "error"


@dataclass(frozen=True)
class Outcome:
    """A turn, or why there is none: ``reason`` is ok, endconversation, context_limit, empty or error."""

    reason: str
    text: str = ""
    facts: dict[str, Any] = field(default_factory=dict)

    @property
    def ended(self) -> bool:
        return self.reason != "ok"


@dataclass(frozen=True)
class UserPolicy:
    """Limits of a user model's turn. A reply is asked for again, warmer by ``warming`` each time."""

    end: str
    stop: str = ""
    temperature: float = 0.7
    warming: float = 0.05
    hottest: float = 1.0
    resamples: int = 7
    refusals: int = 32
    context: int = 8192
    longest: int = 1024

    def heat(self, attempt: int) -> float:
        return min(self.temperature + self.warming * attempt, self.hottest)


def user_turn(policy: UserPolicy, ask: Callable[[float], str], talk: Talk, may_end: bool = True,
              check: Callable[[str, Talk], str | None] | None = None, prompt_tokens: int = 0) -> Outcome:
    """One turn of the simulated user.

    The end token ends the talk, but where the talk may not end yet it is asked again while resamples are left. So is
    an empty reply, which then ends the talk, and a repeat of the user's last turn, which then counts. ``check`` names
    a fault of a reply; after ``policy.refusals`` tries the faulty reply is kept and the talk goes on.
    """
    facts: dict[str, Any] = {"resamples": 0}
    if prompt_tokens + policy.longest > policy.context:
        return Outcome("context_limit", facts=facts)
    said = [t["content"].strip() for t in talk if t["role"] == "user"]
    attempt = 0
    while True:
        try:
            reply = ask(policy.heat(attempt)).strip().removesuffix(policy.stop).strip()
        except Exception as e:
            return Outcome(refusal(e) if isinstance(e, Refused) else "error", facts={**facts, "error": str(e)[:300]})
        facts |= {"resamples": attempt, "temperature": policy.heat(attempt)}
        spare = attempt < policy.resamples
        fault = None
        if policy.end in reply:
            if may_end or not spare:
                return Outcome("endconversation", reply, facts)
            again = True
        elif not reply and not spare:
            return Outcome("empty", facts=facts)
        else:
            again = spare and (not reply or reply in said[-1:])
            fault = None if again or check is None else check(reply, talk)
        if fault is not None:
            facts.setdefault("faults", {})
            facts["faults"][fault] = facts["faults"].get(fault, 0) + 1
            again = attempt < policy.refusals
            if not again:
                facts["kept_with_fault"] = fault
        if not again:
            return Outcome("ok", reply, facts)
        attempt += 1


def synthetic_talk(user: Callable[[Talk, bool], Outcome], assistant: Callable[[Talk], Outcome], valid: Callable[[Talk], bool], most: int = 4) -> tuple[Talk | None, str]:
    """(talk or None, how it ended): up to ``most`` assistant turns; a user turn without an answer is dropped.

    ``user(talk, may_end)`` may not end the talk on its first turn. A talk without any exchange, or one that is not
    ``valid`` in the end, is rejected with the reason.
    """
    talk: Talk = []
    while True:
        turn = user(talk, bool(talk))
        if turn.ended:
            how = turn.reason if talk else f"first_turn_{turn.reason}"
            break
        answer = assistant([*talk, {"role": "user", "content": turn.text}])
        if answer.ended:
            how = f"assistant_{answer.reason}"
            break
        talk += [{"role": "user", "content": turn.text}, {"role": "assistant", "content": answer.text}]
        if len(talk) // 2 >= most:
            how = "max_turns"
            break
    if not talk:
        return None, how
    return (talk, how) if valid(talk) else (None, "invalid")


def task_talk(user: Callable[[Talk], Outcome], assistant: Callable[[Talk], Outcome], most: int = 8) -> Talk | None:
    """A talk about a task, which the user may never end: ``most`` exchanges, or fewer where the user's context is full.

    None where an engine fails (the talk is tried again in a later run) or no first turn comes.
    """
    talk: Talk = []
    while len(talk) // 2 < most:
        turn = user(talk)
        if turn.ended:
            return None if turn.reason == "error" or not talk else talk
        talk.append({"role": "user", "content": turn.text})
        answer = assistant(talk)
        if answer.ended:
            return None
        talk.append({"role": "assistant", "content": answer.text})
    return talk


class Spread:
    """Endpoints chosen by the fewest requests under way; ties go to the first."""

    def __init__(self, endpoints: int):
        self.busy, self._lock, self._mine = [0] * endpoints, threading.Lock(), threading.local()

    def __enter__(self) -> int:
        with self._lock:
            at = self.busy.index(min(self.busy))
            self.busy[at] += 1
        self._mine.at = at
        return at

    def __exit__(self, *_: object) -> None:
        with self._lock:
            self.busy[self._mine.at] -= 1


def assistant_turn(spread: Spread, ask: Callable[[int], str], clean: Callable[[str], str] = str.strip, tries: int = 8, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """One answer of the assistant: the least busy endpoint is asked, up to ``tries`` times; a refusal ends it at once."""
    for k in range(tries):
        try:
            with spread as endpoint:
                text = clean(ask(endpoint))
            if text:
                return Outcome("ok", text)
        except Refused as e:
            return Outcome(refusal(e), facts={"error": str(e)[:300]})
        except Exception as e:
            if k + 1 == tries:
                return Outcome("error", facts={"error": str(e)[:300]})
            sleep(min(1.3**k, 30.0))
    return Outcome("empty")


def many(work: Callable[[Any], Any], items: Iterable[Any], workers: int = 64) -> Iterator[Any]:
    """Results of ``work`` in the order of the items, ``workers`` at a time and no more than twice as many waiting."""
    items = iter(items)
    with ThreadPoolExecutor(workers) as pool:
        waiting = []
        for item in items:
            waiting.append(pool.submit(work, item))
            if len(waiting) >= 2 * workers:
                yield waiting.pop(0).result()
        for done in waiting:
            yield done.result()


def judged(ask: Callable[[], str | None], tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """{status: ok, correct} from a judge that answers in JSON, or {status: error} after ``tries``; Refused goes on to the caller."""
    for k in range(tries):
        try:
            text = ask()
            if text:
                return {"status": "ok", "correct": bool(json.loads(text)["correct"])}
        except Refused:
            raise
        except Exception:
            pass
        sleep(min(2.0 ** (k + 1), 60.0))
    return {"status": "error"}


def label_fault(answer: Any, allowed: set[str]) -> str | None:
    """Why an annotator's answer does not fit {labels: [known labels, at least one], confidence: 0 to 1}; None where it does."""
    if not isinstance(answer, dict) or set(answer) != {"labels", "confidence"}:
        return "fields"
    labels, sure = answer["labels"], answer["confidence"]
    if not isinstance(labels, list) or not labels or not all(isinstance(x, str) and x in allowed for x in labels):
        return "labels"
    if isinstance(sure, bool) or not isinstance(sure, (int, float)) or not 0 <= sure <= 1:
        return "confidence"
    return None


def annotated(ask: Callable[[], tuple[bool, str]], allowed: set[str], threshold: float, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """The logged attempt of one unit: status accepted, low_confidence, invalid, incomplete or error.

    ``ask`` gives (finished, text). An unfinished, unreadable or unfitting answer and a failing call are tried again, up
    to ``tries`` times; the last one's status is logged. Refused goes on to the caller, it would fail for every unit.
    """
    out: dict[str, Any] = {"status": "error", "labels": None, "confidence": None}
    for k in range(tries):
        try:
            finished, text = ask()
            answer = json.loads(text) if finished else None
            fault = label_fault(answer, allowed)
            if not finished:
                out["status"] = "incomplete"
            elif fault is None:
                status = "accepted" if answer["confidence"] >= threshold else "low_confidence"
                return {"status": status, "labels": answer["labels"], "confidence": float(answer["confidence"])}
            else:
                out["status"] = "invalid"
        except Refused:
            raise
        except ValueError:
            out["status"] = "invalid"
        except Exception:
            out["status"] = "error"
        if k + 1 < tries:
            sleep(min(2.0**k, 60.0))
    return out
