"""Model profiles, and the vector of the query at hand."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..schema import MODEL_PROFILES
from .chunking import prepare_query
from .embedding import Embedder


@dataclass(frozen=True)
class Profile:
    """What a model's vectors depend on; notes are embedded anew when its fingerprint changes."""

    name: str
    dims: int
    context_limit: int
    pooling: str
    contextual: bool = False
    late: bool = False

    @property
    def fingerprint(self) -> str:
        return ":".join((self.name, self.pooling, f"d{self.dims}", f"t{self.context_limit}", "late" if self.late else "standard"))


PROFILES = {p.name: p for p in (Profile(*row) for row in MODEL_PROFILES)}


def profile(name: str, late: bool = False) -> Profile:
    """A registered profile; late chunking is for contextual models alone."""
    if name not in PROFILES:
        raise LookupError(f"no profile {name!r}")
    if late and not PROFILES[name].contextual:
        raise ValueError(f"{name} has no late chunking")
    return replace(PROFILES[name], late=late)


class StaleQuery(RuntimeError):
    """The query was replaced, or the vectors of another model are served."""


class QueryVectors:
    """The vector of one query at a time: asked again it is not embedded anew, and a new text or model forgets it."""

    def __init__(self, embedder: Embedder):
        self._embedder, self._asked, self._vector = embedder, None, None

    def ask(self, text: str) -> None:
        """Make ``text`` the current query; a blank one leaves none."""
        asked = (text, self._embedder.fingerprint) if text.strip() else None
        if asked != self._asked:
            self._asked, self._vector = asked, None

    def use(self, embedder: Embedder) -> None:
        """Change the model: the vector held is of no use to another one."""
        if embedder.fingerprint != self._embedder.fingerprint:
            self._asked = self._vector = None
        self._embedder = embedder

    def vector(self, text: str, fingerprint: str) -> list[float]:
        """Unit-length vector of the current query under the model that the index was built with; too long a query is an error."""
        if fingerprint != self._embedder.fingerprint:
            raise StaleQuery("the index was built with another model")
        if self._asked != (text, fingerprint):
            raise StaleQuery("this is not the current query")
        if self._vector is None:
            prepare_query(text, self._embedder.context_limit, self._embedder.count)
            self._vector = self._embedder.embed([text])[0]
        return self._vector
