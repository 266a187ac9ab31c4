from __future__ import annotations

from pathlib import Path

from factloom.llm.common import lean


def _held_mb() -> float:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_lean_gives_back_what_lies_below_memory_still_in_use():
    pinned = []

    def run(batches):
        for batch in batches:
            held = [bytes(1000) for _ in range(200_000)]
            pinned.append(held[-1])
            yield batch

    before = _held_mb()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert _held_mb() - before < 60
