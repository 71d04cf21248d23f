"""A named bundle of tables that share a sample key, and operations on all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from helixmill.operators import align, fuse, impute, normalize
from helixmill.operators.matrix import numeric_columns
from helixmill.operators.quality import modality_report


@dataclass(frozen=True)
class OmicsTables:
    """Tables by modality; ``problems`` names the modalities an operation could not change."""

    tables: Mapping[str, DataFrame]
    key: str
    problems: Mapping[str, str] = field(default_factory=dict)

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def map(self, work: Callable[[str, DataFrame], DataFrame]) -> OmicsTables:
        """Apply ``work`` to every table; where it fails the table stays as it was."""
        out, problems = {}, dict(self.problems)
        for name, table in self.tables.items():
            try:
                out[name] = work(name, table)
            except Exception as error:  # one modality must not stop the others
                out[name], problems[name] = table, str(error)
        return OmicsTables(out, self.key, problems)

    def impute(self, strategy: str = "median", by_modality: Mapping[str, str] | None = None) -> OmicsTables:
        return self.map(lambda n, t: impute.impute(t, (by_modality or {}).get(n, strategy), key=self.key))

    def scale(self, method: str = "standard", by_modality: Mapping[str, str] | None = None) -> OmicsTables:
        return self.map(lambda n, t: fuse.scale_columns(t, self.key, (by_modality or {}).get(n, method)))

    def fit(self, method: str = "standard", by_modality: Mapping[str, str] | None = None) -> FittedTables:
        """Statistics of every table by its method, to be applied to this or to another bundle."""
        return FittedTables({n: normalize.fit_columns(t, numeric_columns(t, [self.key]), (by_modality or {}).get(n, method)) for n, t in self.tables.items()})

    def align(self) -> OmicsTables:
        return OmicsTables(align.align(self.tables, self.key), self.key, self.problems)

    def fuse(self, method: str = "early", **options):
        return fuse.integrate(self.tables, self.key, (method,), **options)[method]

    def quality(self) -> DataFrame:
        rows = [modality_report(n, t, self.key) for n, t in self.tables.items()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out


@dataclass(frozen=True)
class FittedTables:
    """Fitted statistics by modality; tables of other names stay as they are."""

    fitted: Mapping[str, normalize.FittedColumns]

    def transform(self, bundle: OmicsTables) -> OmicsTables:
        return OmicsTables({n: self.fitted[n].transform(t) if n in self.fitted else t for n, t in bundle.tables.items()}, bundle.key, bundle.problems)
