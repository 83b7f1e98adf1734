"""Study specifications: small mappings read on the driver, with rules that say what is wrong with one.

Each rule names the part of the specification it looks at; a part that is missing or of the wrong kind breaks
its own rules only, so a report lists everything at once."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from pathlib import Path
from typing import Any

# The keys of a specification, its de-duplication rules and the ends of a filter ladder.
KEYS = (
    "experiment_id", "campaign_id", "hypothesis", "instrument", "data_interval", "partitions", "eligible_session", "direction_definition", "event_condition",
    "deduplication_rule", "cooldown", "base_parameters", "sensitivity_parameters", "expected_information_time",
)
FIRST_STEP, LAST_STEP = "BASE_TRIGGER", "FINAL_EVENT"
LEAST_HYPOTHESIS, LEAST_PROBED, MOST_PROBED = 20, 3, 2


class SpecError(ValueError):
    """A specification that is no mapping, or breaks a rule."""


@dataclass(frozen=True)
class Frame:
    """What a specification must agree with: the instrument's interval and hours, and the rules of de-duplication."""

    instrument: str
    interval: str
    open_minute: int
    close_minute: int
    bar_minutes: int
    dedup: tuple[str, ...] = ("first_per_timestamp",)


def load(path: str) -> dict[str, Any]:
    """A JSON or, where PyYAML is there, YAML specification."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise SpecError("PyYAML is not there; write the specification as JSON") from e
        got = yaml.safe_load(text)
    else:
        got = json.loads(text)
    if not isinstance(got, dict):
        raise SpecError("a specification is a mapping")
    return got


def _text(x: Any) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _count(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def _minute(x: Any) -> int | None:
    h, _, m = str(x).partition(":")
    return int(h) * 60 + int(m) if len(h) == len(m) == 2 and h.isdigit() and m.isdigit() and int(h) < 24 and int(m) < 60 else None


def _years_after(a: date, b: date) -> float:
    return b.year - a.year if (a.month, a.day) == (b.month, b.day) else math.nan


def _partitions(p: Any, spec: dict, frame: Frame) -> Iterator[str]:
    try:
        dev, end, lock = (date.fromisoformat(str(p[k])) for k in ("development_end", "selection_holdout_end", "lockbox_start"))
    except (KeyError, TypeError, ValueError):
        yield "needs the dates development_end, selection_holdout_end and lockbox_start"
        return
    if _years_after(dev, end) not in (1, 2) or lock != end:
        yield "the holdout takes one or two whole years and the lockbox follows at once"


def _session(s: Any, spec: dict, frame: Frame) -> Iterator[str]:
    lo, hi = (_minute(s.get(k)) if isinstance(s, dict) else None for k in ("start", "end"))
    if lo is None or hi is None:
        yield "needs start and end as HH:MM"
    elif not frame.open_minute + frame.bar_minutes <= lo < hi <= frame.close_minute:
        yield "lies within regular hours, after their first bar"


def _direction(d: Any, spec: dict, frame: Frame) -> Iterator[str]:
    if not (isinstance(d, dict) and _text(d.get("rule")) and d.get("values") in ([1], [-1])):
        yield "needs a rule and values [1] or [-1]"


def _condition(c: Any, spec: dict, frame: Frame) -> Iterator[str]:
    if not (isinstance(c, dict) and _text(c.get("description")) and isinstance(c.get("parameters_used"), list)):
        yield "needs a description and parameters_used"
    elif unknown := sorted(set(c["parameters_used"]) - set(_parameters(spec))):
        yield f"uses {unknown}, which base_parameters lacks"


def _parameters(spec: dict) -> dict:
    p = spec.get("base_parameters")
    return p if isinstance(p, dict) else {}


def _probed(names: Any, spec: dict, frame: Frame) -> Iterator[str]:
    if not isinstance(names, list) or len(names) > MOST_PROBED:
        yield f"is a list of at most {MOST_PROBED} names"
        return
    for n in names:
        v = _parameters(spec).get(n)
        if v is None:
            yield f"{n!r} is not in base_parameters"
        elif isinstance(v, int) and v < LEAST_PROBED:
            yield f"{n!r} is an integer below {LEAST_PROBED}: its probes would not differ"


def _known_at(x: Any, spec: dict, frame: Frame) -> Iterator[str]:
    delay = x.get("confirmation_delay_bars") if isinstance(x, dict) else None
    if not (isinstance(x, dict) and _text(x.get("rule"))):
        yield "needs a rule"
    if not (_count(delay) or (isinstance(delay, str) and delay in _parameters(spec))):
        yield "needs confirmation_delay_bars: a count, or the name of a base parameter"


def _ladder(x: Any, spec: dict, frame: Frame) -> Iterator[str]:
    ok = isinstance(x, list) and len(x) >= 2 and all(map(_text, x)) and len(set(x)) == len(x)
    if x is not None and not (ok and x[0] == FIRST_STEP and x[-1] == LAST_STEP):
        yield f"is a list of different steps from {FIRST_STEP} to {LAST_STEP}"


def _says(test: Callable[[Any, Frame], bool], message: str) -> Callable:
    def rule(x: Any, spec: dict, frame: Frame) -> Iterator[str]:
        if not test(x, frame):
            yield message

    return rule


RULES: tuple[tuple[str, Callable], ...] = (
    ("hypothesis", _says(lambda x, f: _text(x) and len(x.strip()) >= LEAST_HYPOTHESIS and "TODO" not in x, f"is a sentence of {LEAST_HYPOTHESIS} characters or more, without TODO")),
    ("instrument", _says(lambda x, f: x == f.instrument, "is not the instrument of the data")),
    ("data_interval", _says(lambda x, f: str(x) == f.interval, "is not the interval of the data")),
    ("partitions", _partitions),
    ("eligible_session", _session),
    ("direction_definition", _direction),
    ("event_condition", _condition),
    ("deduplication_rule", _says(lambda x, f: x in f.dedup, "is not a known rule")),
    ("cooldown", _says(lambda x, f: isinstance(x, dict) and _count(x.get("bars")), "needs bars, a count")),
    ("base_parameters", _says(lambda x, f: isinstance(x, dict) and all(map(_number, x.values())), "is a mapping of names to finite numbers")),
    ("sensitivity_parameters", _probed),
    ("expected_information_time", _known_at),
    ("filter_ladder", _ladder),
)


def problems(spec: dict[str, Any], frame: Frame, **same: Any) -> list[str]:
    """Everything that is wrong with a specification, as ``part: message``; ``same``: values that parts must have."""
    out = [f"{k}: is missing" for k in KEYS if k not in spec]
    out += [f"{k}: is not {v!r}" for k, v in same.items() if k in spec and spec[k] != v]
    return out + [f"{part}: {m}" for part, rule in RULES if part in spec for m in rule(spec[part], spec, frame)]


def checked(spec: dict[str, Any], frame: Frame, **same: Any) -> dict[str, Any]:
    if bad := problems(spec, frame, **same):
        raise SpecError("; ".join(bad))
    return spec
