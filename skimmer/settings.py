"""Parameters from the environment: SKIMMER_<SECTION>__<FIELD> changes a field of a section's parameter class.

The classes own their fields, defaults and checks; a section only names the class.
"""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from dataclasses import dataclass

from .functions.sizing import CountMinGeometry, HllGeometry

PREFIX = "SKIMMER_"


@dataclass(frozen=True)
class Output:
    """Where result documents go, and the seed that they record."""

    folder: str = "results"
    seed: int = 0


SECTIONS: dict[str, object] = {"count_min": CountMinGeometry(), "hll": HllGeometry(11), "output": Output()}


def of(section: str, env: Mapping[str, str] | None = None) -> object:
    """The section's parameters; a name that the section lacks is an error, as are values that its class refuses."""
    base, start = SECTIONS[section], f"{PREFIX}{section.upper()}__"
    given = {k.removeprefix(start).lower(): v for k, v in (os.environ if env is None else env).items() if k.startswith(start)}
    if unknown := set(given) - {f.name for f in dataclasses.fields(base)}:
        raise ValueError(f"unknown settings of {section}: {', '.join(sorted(unknown))}")
    return dataclasses.replace(base, **{k: type(getattr(base, k))(v) for k, v in given.items()})


def check(env: Mapping[str, str] | None = None) -> None:
    """Every name in the environment that begins like a setting must be one."""
    names = os.environ if env is None else env
    for name in names:
        if name.startswith(PREFIX) and name.removeprefix(PREFIX).partition("__")[0].lower() not in SECTIONS:
            raise ValueError(f"unknown setting {name}")
    for section in SECTIONS:
        of(section, names)
