"""Finding the files of a library source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

#: Where files are looked for below a folder, in order of precedence. Fixed values.
PEAKS = ("all.db", "mass/all.db")
GENES = ("mass/all_genes.db", "all_genes.db", "genes.db", "custom/custom_genes.db")
NAMES = ("names.db", "custom/custom_names.db")
TAXONOMY = ("taxonomy/gtdb_taxonomy.db", "taxonomy/ncbi_taxonomy.db", "taxonomy/ssu_silva_taxonomy.db", "taxonomy/ssu_gg_taxonomy.db", "taxonomy.db", "custom/custom_taxonomy.db")


@dataclass
class Sources:
    peaks: Path
    genes: Path | None
    names: Path | None
    taxonomy: Path | None


def _lineage(path: Path) -> Iterator[Path]:
    folder = path if path.is_dir() else path.parent
    yield folder
    yield from folder.parents


def _first(roots: list[Path], suffixes: tuple[str, ...]) -> Path | None:
    return next((r / s for r in roots for s in suffixes if (r / s).is_file()), None)


def discover(path: str | Path, genes: str | None = None, names: str | None = None, taxonomy: str | None = None) -> Sources:
    """Files from a folder, or a file in it, and all folders above: the first that is there counts. Metadata is looked for from the folder first,
    then from where the peaks were found; paths that are given override."""
    start = Path(path).absolute()
    own = list(_lineage(start))
    peaks = start if start.is_file() and start.name == "all.db" else _first(own, PEAKS)
    if peaks is None:
        raise FileNotFoundError(f"missing required all.db for {path}")
    roots = list(dict.fromkeys([*own, *_lineage(peaks)]))
    given = lambda x, suffixes: Path(x) if x else _first(roots, suffixes)
    return Sources(peaks, given(genes, GENES), given(names, NAMES), given(taxonomy, TAXONOMY))
