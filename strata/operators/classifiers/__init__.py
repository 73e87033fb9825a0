"""Format classifiers: bytes in, one verdict or none out, with the byte streams that the format holds.

Each is a function ``classify(data) -> Verdict | None``. A function that raises gives no verdict: the next
candidate is asked (``ask``). Only the standard library is used, so descriptions that need a full decoder
are approximate.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import partial

from strata.functions.types import LAST, PRECEDENCE, TYPES
from strata.sources.views import view

OWNER = {code: k for code, _, _, k in TYPES}
MAX_DEPTH = 16
THRESHOLD = 50
#: Seconds that a classifier may take for one item, where it has no time of its own; None is no end (fixed values).
TIMEOUT = 60.0
TIMEOUTS = {"compression": 600.0, "sleuth": None}


@dataclass(frozen=True)
class Limits:
    """Bounds on what one item may unfold to. A verdict whose children were cut says TRUNCATED; None is no bound.

    ``zlib_input`` and ``zlib_ratio`` (output to input) are those of the described zlib classifier.
    """

    child_bytes: int | None = 64 << 20
    zlib_input: int | None = 10_000_000
    zlib_ratio: int | None = 10
    timeouts: Mapping[str, float | None] = field(default_factory=lambda: dict(TIMEOUTS), hash=False)
    timeout: float | None = TIMEOUT  #: of classifiers that ``timeouts`` does not name


#: No bound at all, for inputs that are trusted.
WHOLE = Limits(None, None, None)


@dataclass
class Verdict:
    classifier: str
    confidence: int
    brief: str
    description: str
    length: int = 0  #: bytes that the item spans, 0 if unknown
    kind: str = ""  #: name of the container directory in children's paths
    children: list[tuple[str, bytes]] = field(default_factory=list)
    #: bytes (offset, length) that the item is made of, where they are not the first ``length`` ones
    ranges: list[tuple[int, int]] = field(default_factory=list)
    #: children that lie in the item as they are: name, and stretches (offset, length)
    stored: list[tuple[str, list[tuple[int, int]]]] = field(default_factory=list)
    #: nothing but a short mark speaks for it, which any bytes may bear by chance: it stands where no other classifier's verdict does
    weak: bool = False


#: Classifiers that take a view (``read(at, n)``, ``size``) and read what they need of it, whatever its size.
VIEWED = frozenset({"sleuth", "partitiontable"})


@dataclass(frozen=True)
class Registry:
    """Which classifiers there are, what they claim, in which order they are asked, and from which confidence on they are believed.

    It travels with a query to the executors by value, with the functions in it. ``claims`` are type codes that a
    classifier of ``functions`` claims besides those of the general table; what ``off`` names is not asked.
    """

    functions: Mapping[str, object] = field(default_factory=dict, hash=False)
    claims: Mapping[str, tuple[int, ...]] = field(default_factory=dict, hash=False)
    precedence: tuple[str, ...] = tuple(PRECEDENCE)
    thresholds: Mapping[str, int] = field(default_factory=dict, hash=False)
    threshold: int = THRESHOLD
    off: frozenset[str] = frozenset()

    def asked(self, types: list[int]) -> list[str]:
        """Names of the classifiers that claim one of the types, in the order in which they are asked."""
        found = {OWNER[t] for t in types if OWNER.get(t)} | {name for name, codes in self.claims.items() if set(codes) & set(types)}
        order = {name: k for k, name in enumerate(self.precedence)}
        return sorted(found - self.off, key=lambda n: (order.get(n, LAST), n))

    def least(self, name: str) -> int:
        """Confidence from which a classifier's verdict stands."""
        return self.thresholds.get(name, self.threshold)

    def rows(self) -> list[tuple[str, int, int, int]]:
        """classifier, type code, precedence, threshold of every claim."""
        order = {name: k for k, name in enumerate(self.precedence)}
        pairs = {(c, t) for t, c in OWNER.items() if c} | {(c, t) for c, codes in self.claims.items() for t in codes}
        return sorted((c, t, order.get(c, LAST), self.least(c)) for c, t in pairs if c not in self.off)


_registered: dict = {}
_claimed: dict = {}


def register(name: str, classify, types: tuple[int, ...] = ()) -> None:
    """Adds a classifier ``classify(data) -> Verdict | None``, or puts one in another's place, in queries that are
    built from now on (``registry``). ``types``: codes that it claims besides those of the general table."""
    _registered[name] = classify
    _claimed[name] = tuple(types)


def registry(base: Registry | None = None, thresholds: Mapping[str, int] | None = None) -> Registry:
    """A registry with what is registered in this process, to go with a query."""
    base = base or Registry()
    return replace(base, functions={**_registered, **base.functions}, claims={**_claimed, **base.claims}, thresholds={**base.thresholds, **(thresholds or {})})


def known(limits: Limits = Limits(), functions: Mapping[str, object] | None = None):  # noqa: B008  frozen
    """Classifiers by name; types come from the registry."""
    from strata.operators.classifiers import archive, av, fat, image, jbig, mbr, ole, pdf, zlib_

    own = {"sleuth": fat.classify, "partitiontable": mbr.classify, "ole": ole.classify, "pdf": pdf.classify, "image": image.classify, "video": av.classify, "jbig": jbig.classify}
    return own | {"compression": partial(archive.classify, limits=limits), "zlib": partial(zlib_.classify, limits=limits)} | dict(_registered if functions is None else functions)


@contextmanager
def within(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in what runs longer. Signals reach the main thread only, so elsewhere nothing is bounded;
    Python workers of Spark run functions in theirs. A call into compiled code is left when it returns."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeoutError(f"no answer within {seconds} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def ask(
    names: list[str], data: bytes, extra: dict | None = None, limits: Limits = Limits(), thresholds: Mapping[str, int] | None = None,  # noqa: B008
    reg: Registry | None = None, whole=None,
) -> Verdict | None:
    """The first verdict at or above its classifier's threshold (``thresholds``, else those of ``reg``), in the given order.

    A weak verdict stands only if no other does. A classifier that raises or takes longer than its time gives none. ``whole``: a view of all bytes of the item, for those that
    take views; children that lie in it are then told by their places, else they come as bytes.
    """
    functions = known(limits, reg.functions if reg else None) | (extra or {})
    reg, chance = reg or Registry(), None
    for name in names:
        f = functions.get(name)
        if f is None:
            continue
        by_place = name in VIEWED and whole is not None
        try:
            with within(limits.timeouts.get(name, limits.timeout)):
                v = f(whole if by_place else data)
        except Exception:  # noqa: BLE001  a broken input or classifier must not take the item with it
            continue
        if v is not None and v.confidence >= (thresholds or {}).get(name, reg.least(name)):
            if v.weak:
                chance = chance or v
                continue
            if v.stored and not by_place:
                held = view(data)
                v.children, v.stored = v.children + [(n, b"".join(held.read(*p) for p in places)) for n, places in v.stored], []
            v.children, cut = [(n, c) for n, c in v.children if c], False
            if limits.child_bytes is not None:
                cut = any(len(c) > limits.child_bytes for _, c in v.children)
                v.children = [(n, c[: limits.child_bytes]) for n, c in v.children]
            if cut and "TRUNCATED" not in v.description:
                v.description += " TRUNCATED"
            return v
    return chance
