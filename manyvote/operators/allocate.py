"""Which learner trains which member."""

from __future__ import annotations

from collections.abc import Sequence


def allocate_members(members: int, methods: Sequence[str]) -> list[str]:
    """The method of every member: equal consecutive shares, the last method takes the remainder."""
    if members < len(methods):
        raise ValueError(f"{members} members cannot cover {len(methods)} methods")
    share = members // len(methods)
    return [methods[min(member // share, len(methods) - 1)] for member in range(members)]
