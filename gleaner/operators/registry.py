"""The registry of channels: in order, by id, and how to run them over one artifact."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from gleaner.grammar import DEFAULT, Grammar
from gleaner.operators.channels import Artifact, Channel, default_channels


class Outcome(NamedTuple):
    extractor: str
    ord: int
    applied: bool
    hits: list[tuple[int, str, str, str]]  # order, token, method, context
    error: str | None


class Registry:
    def __init__(self, channels: Iterable[Channel] = ()):
        self.channels: list[Channel] = []
        self.register_all(channels)

    def register(self, channel: Channel) -> Registry:
        if any(c.id == channel.id for c in self.channels):
            raise ValueError(f"channel {channel.id!r} is registered already")
        self.channels.append(channel)
        return self

    def register_all(self, channels: Iterable[Channel]) -> Registry:
        for c in channels:
            self.register(c)
        return self

    @property
    def ids(self) -> list[str]:
        return [c.id for c in self.channels]

    @property
    def body_ids(self) -> list[str]:
        """Of the channels that run() runs."""
        return [c.id for c in self.channels if c.applies is not None]

    def applicable_to(self, artifact: Artifact) -> list[str]:
        """Ids of the body channels that claim the artifact; one that fails to say doesn't."""
        return [o.extractor for o in self.run(artifact) if o.applied]

    def run(self, artifact: Artifact, grammar: Grammar = DEFAULT) -> list[Outcome]:
        """Every body channel over one artifact. One that fails gives no hits but its error; the others go on. One that
        fails to say whether it applies doesn't."""
        out = []
        for k, c in enumerate(self.channels):
            if c.applies is None:
                continue
            applied, hits, error = False, [], None
            try:
                applied = bool(c.applies(artifact))
                if applied:
                    for i, (method, text) in enumerate(c.texts(artifact)):
                        hits += [(i << 32 | at, token, method, context) for token, at, context in grammar.find(text)]
            except Exception as e:  # a channel is a plug-in: whatever it raises is its own
                hits, error = [], str(e) or type(e).__name__
            out.append(Outcome(c.id, k, applied, hits, error))
        return out


def default_registry(**options) -> Registry:
    return Registry(default_channels(**options))
