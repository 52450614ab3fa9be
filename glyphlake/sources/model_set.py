"""Model files: where they come from, and what a set must hold."""

from __future__ import annotations

import asyncio
import hashlib
import tempfile
from dataclasses import dataclass, replace
from enum import Enum
from functools import lru_cache
from io import BytesIO
from pathlib import Path
from typing import BinaryIO, Protocol

from glyphlake.operators.models import OnnxModels
from glyphlake.sources.bench import parse_dictionary


class Kind(Enum):
    DETECTION = "detection"
    CLASSIFICATION = "classification"
    RECOGNITION = "recognition"
    DICTIONARY = "dictionary"


class Provider(Protocol):
    """Gives a model's bytes; implement it to take models from packages or stores."""

    kind: Kind

    def open(self) -> BinaryIO: ...


@dataclass(frozen=True)
class FileProvider:
    kind: Kind
    path: str

    def open(self) -> BinaryIO:
        return open(self.path, "rb")


def require(provider: Provider | None, kind: Kind) -> Provider:
    if provider is None or provider.kind is not kind:
        raise ValueError(f"a {kind.value} model is needed here")
    return provider


@dataclass(frozen=True)
class Bundle:
    """Detection, recognition, dictionary and, if lines may be upside down, classification."""

    detection: Provider
    recognition: Provider
    dictionary: Provider
    classification: Provider | None = None

    def __post_init__(self):
        require(self.detection, Kind.DETECTION)
        require(self.recognition, Kind.RECOGNITION)
        require(self.dictionary, Kind.DICTIONARY)
        if self.classification is not None:
            require(self.classification, Kind.CLASSIFICATION)


def from_paths(detector: str, recogniser: str, dictionary: str, classifier: str | None = None) -> OnnxModels:
    """Models of files that are at the same place on every machine; a missing file is an error."""
    for path in (detector, recogniser, dictionary, classifier):
        if path is not None and not Path(path).is_file():
            raise FileNotFoundError(path)
    return OnnxModels(detector, recogniser, tuple(parse_dictionary(Path(dictionary).read_bytes())), classifier)


def from_streams(detector: BinaryIO, recogniser: BinaryIO, dictionary: BinaryIO, classifier: BinaryIO | None = None, folder: str | None = None) -> OnnxModels:
    """Models read from open streams, which stay open and are the caller's to close; see from_bundle()."""

    @dataclass(frozen=True)
    class Given:
        kind: Kind
        stream: BinaryIO

        def open(self) -> BinaryIO:
            return BytesIO(self.stream.read())

    parts = [Given(k, x) for k, x in zip((Kind.DETECTION, Kind.RECOGNITION, Kind.DICTIONARY), (detector, recogniser, dictionary))]
    return from_bundle(Bundle(*parts, Given(Kind.CLASSIFICATION, classifier) if classifier else None), folder)


def from_bundle(bundle: Bundle, folder: str | None = None) -> OnnxModels:
    """Writes a bundle's models below ``folder``, a new temporary one by default, and loads them there.

    Files have names of their own, so that several sets can be sent: ship()
    takes them to the executors. A set that fails to load leaves no file.
    """
    base = Path(folder or tempfile.mkdtemp(prefix="glyphlake-models-"))
    names: dict[str, str] = {}
    try:
        for slot in ("detection", "recognition", "dictionary", "classification"):
            provider = getattr(bundle, slot)
            if provider is not None:
                with provider.open() as source:
                    data = source.read()
                names[slot] = str(base / f"{slot}-{hashlib.sha256(data).hexdigest()[:16]}.bin")
                Path(names[slot]).write_bytes(data)
        return from_paths(names["detection"], names["recognition"], names["dictionary"], names.get("classification"))
    except Exception:
        for name in names.values():
            Path(name).unlink(missing_ok=True)
        raise


async def load_async(load, *args, **named) -> OnnxModels:
    """from_paths(), from_streams() or from_bundle() beside other work: files are read in a thread."""
    return await asyncio.to_thread(load, *args, **named)


def ship(spark, models: OnnxModels) -> OnnxModels:
    """Sends the model files along with the application; returns the models as every machine finds them."""
    for path in (models.detector, models.recogniser, models.classifier):
        if path:
            spark.sparkContext.addFile(path)
    return replace(models, shipped=True)


def normalized(name: str | None) -> str:
    """tiny, small or medium; nothing given is tiny."""
    known = (name or "tiny").strip().lower()
    if known not in ("tiny", "small", "medium"):
        raise ValueError(f"unknown model {name!r}")
    return known


@lru_cache
def named(folder: str, name: str) -> OnnxModels:
    """One set for each name and process, loaded when first asked for: det.onnx, rec.onnx, dict.txt and, if there, cls.onnx."""
    base = Path(folder, normalized(name))
    cls = base / "cls.onnx"
    return from_paths(str(base / "det.onnx"), str(base / "rec.onnx"), str(base / "dict.txt"), str(cls) if cls.is_file() else None)
