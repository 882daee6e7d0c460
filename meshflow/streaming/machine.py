"""The exact firing rule of one callback for arrivals in any order.

State of each array: its window of the last `size` timesteps, whether it changed since the last firing,
and its last timestep. The machine is plain data, so that the driver and the stateful operator on the
executors share it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence


class TriggerMachine:
    def __init__(self, arrays: Sequence[tuple[str, int]], when: str = "AND"):
        if when not in ("AND", "OR"):
            raise ValueError(f"when is AND or OR, not {when}")
        self.when, self.order = when, [name for name, _ in arrays]
        self.size = dict(arrays)  # the last size of a repeated name holds
        self.window: dict[str, list] = {n: [] for n in self.size}
        self.changed = dict.fromkeys(self.size, False)
        self.last: dict[str, int | None] = dict.fromkeys(self.size)

    def arrive(self, name: str, timestep: int, item=None) -> tuple[str, list[list] | str] | None:
        """("fire", windows in order of registration), ("late", message), or None. item: what windows hold."""
        last = self.last[name]
        if last is not None and timestep < last:
            return "late", f"timestep {timestep} of {name} is below {last}"
        window = self.window[name]
        window.append(timestep if item is None else item)
        del window[: max(0, len(window) - self.size[name])]
        self.changed[name], self.last[name] = True, timestep
        if self.when == "OR":
            self.changed[name] = False
        elif all(self.changed.values()) and len(set(self.last.values())) == 1:
            self.changed = dict.fromkeys(self.size, False)
        else:
            return None
        return "fire", [list(self.window[n]) for n in self.order]

    def dump(self) -> str:
        return json.dumps([self.when, self.order, self.size, self.window, self.changed, self.last])

    @staticmethod
    def load(text: str) -> TriggerMachine:
        out = TriggerMachine([])
        out.when, out.order, out.size, out.window, out.changed, out.last = json.loads(text)
        return out
