"""Where fields come from: driver tables, generators, array files, registered loaders."""

from eigenflux.sources.files import load, register_loader
from eigenflux.sources.generators import generate

__all__ = ["generate", "load", "register_loader"]
