"""Modal decomposition of spatiotemporal tables on Spark DataFrames."""

__version__ = "0.1.0"

from eigenflux.config import Case, Run, execute
from eigenflux.dataset import Dataset, densify, from_array
from eigenflux.registry import (
    BSMDAnalyzer,
    DMDAnalyzer,
    HODMDAnalyzer,
    MPODAnalyzer,
    PODAnalyzer,
    PSDPODAnalyzer,
    SPODAnalyzer,
    STPODAnalyzer,
    TLSHODMDAnalyzer,
    method,
    methods,
    run,
)
from eigenflux.results import Result, inspect, latest, provenance
from eigenflux.session import session

__all__ = [
    "BSMDAnalyzer", "Case", "DMDAnalyzer", "Dataset", "HODMDAnalyzer", "MPODAnalyzer", "PODAnalyzer", "PSDPODAnalyzer", "Result", "Run", "SPODAnalyzer",
    "STPODAnalyzer", "TLSHODMDAnalyzer", "densify", "execute", "from_array", "inspect", "latest", "method", "methods", "provenance", "run", "session",
]
