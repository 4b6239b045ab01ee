"""Setting Spark ML parameters by name."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.ml.param import Params

from millrace.util import require

_recorder: ContextVar[list | None] = ContextVar("recorder", default=None)


@contextmanager
def recording():
    """Collect the fitted stages of the operators used inside, in order.

    ``with recording() as stages:`` gives a list that, together with a trained
    model, can be saved as one pipeline.
    """
    stages: list = []
    token = _recorder.set(stages)
    try:
        yield stages
    finally:
        _recorder.reset(token)


def record(stage):
    """Note a fitted stage if someone is collecting them."""
    stages = _recorder.get()
    if stages is not None:
        stages.append(stage)
    return stage


def configure(stage: Params, **params) -> Params:
    """Set parameters by name; None leaves the default.

    Text is converted to the type of the parameter's default, so that values
    from a configuration file can be passed as they are.
    """
    for name, value in params.items():
        require(stage.hasParam(name), f"{type(stage).__name__} has no parameter {name}")
        if value is None:
            continue
        param = stage.getParam(name)
        if isinstance(value, str) and stage.hasDefault(param):
            value = _typed(name, value, stage.getOrDefault(param))
        stage.set(param, value)
    return stage


def _typed(name: str, text: str, default):
    if isinstance(default, bool):
        require(text.lower() in ("true", "false"), f"{name} must be true or false, not {text}")
        return text.lower() == "true"
    if isinstance(default, (int, float)):
        try:
            return type(default)(text)
        except ValueError:
            raise ValueError(f"{name} must be a number, not {text}") from None
    return text


def numbers(value) -> list[float]:
    """A list of numbers, or the same as comma-separated text."""
    if isinstance(value, str):
        value = [v for v in value.split(",") if v.strip()]
    return [float(v) for v in value]
