"""Versioned datasets: numbered folders, a manifest each, and a registry of them."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tidewheel.sources import files, sinks

REGISTRY_NAMES = ("version.json", "versions.json")
MARK = "latest_processed_input"


class VersionedDataset:
    """Numbered versions of one or more named tables below a root folder.

    ``write`` fills ``versions/<v>/<part>`` first and the registry last, so a job that
    dies leaves nothing that readers would find.  Which version is the latest, and with it the
    mark of what was processed, follows from the order of the versions and not from the order
    in which their manifests arrive: numbers count as numbers, other names as text, and a
    registry that names a later version than an unlisted manifest keeps it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def registry(self) -> dict:
        """The registry file, with versions whose manifest is written but not listed yet.

        A job that died between manifest and registry, or two jobs that wrote the registry at
        once, therefore lose nothing.  A file that cannot be read stops the job.
        """
        registry = self._file()
        listed = {self._name(e) for e in registry["versions"]}
        for version in sorted(files.folders(self.spark, f"{self.root}/versions"), key=self._place):
            if version in listed:
                continue
            manifest = files.read_json(self.spark, f"{self.folder(version)}/manifest.json", None)
            if isinstance(manifest, dict) and manifest.get("version") == version:
                self._enter(registry, manifest)
        return registry

    def _file(self) -> dict:
        """The registry file as it is."""
        registry: dict = {"versions": [], "latest": None}
        for name in REGISTRY_NAMES:
            path = f"{self.root}/registry/{name}"
            found = files.read_json(self.spark, path, None)
            if found is None:
                continue
            if not isinstance(found, dict) or not isinstance(found.get("versions", []), list):
                raise ValueError(f"{path} is no registry")
            registry = {"versions": [], **found}
            break
        return registry

    def _enter(self, registry: dict, manifest: dict, again: bool = False) -> bool:
        """List a manifest; as the latest version, with its mark, unless a later one is known.
        A listed version that is written ``again`` on purpose becomes the latest all the same."""
        version = manifest["version"]
        others = [e for e in registry["versions"] if self._name(e) != version]
        registry["versions"] = others + [manifest]
        latest = self._name(registry.get("latest_version") or registry.get("latest"))
        older = latest is not None and self._place(latest) > self._place(version)
        if older and not again:
            return False
        registry["latest"] = registry["latest_version"] = version
        if manifest.get(MARK) is not None and not older:
            registry[MARK] = manifest[MARK]
        return True

    @staticmethod
    def _place(version: str) -> tuple:
        number = re.fullmatch(r"v(\d+)", str(version))
        return (0, int(number.group(1)), "") if number else (1, 0, str(version))

    @staticmethod
    def _name(entry) -> str | None:
        return entry.get("version") if isinstance(entry, Mapping) else entry

    def next_version(self) -> str:
        """``v0001`` and on, after the greatest number in registry or latest."""
        registry = self.registry()
        names = [self._name(e) for e in registry["versions"]] + [
            registry.get("latest"), registry.get("latest_version"),
        ]
        numbers = [int(m.group(1)) for n in names if n and (m := re.fullmatch(r"v(\d+)", str(n)))]
        return f"v{max(numbers, default=0) + 1:04d}"

    def claim_version(self) -> str:
        """The next number, made this writer's own by a file that only one writer can create.

        A number that another job claimed is passed over, whether that job is at work or died.
        """
        number = int(self.next_version()[1:])
        while not files.create_new(self.spark, f"{self.folder(f'v{number:04d}')}/_claimed"):
            number += 1
        return f"v{number:04d}"

    def folder(self, version: str) -> str:
        return f"{self.root}/versions/{version}"

    def write(
        self,
        tables: Mapping[str, DataFrame],
        version: str | None = None,
        info: Mapping | None = None,
        rows_per_file: int = 50_000,
        partition_by: Mapping[str, list[str]] | None = None,
    ) -> dict:
        """Write all tables of a version, then its manifest and registry entry.

        Writing the same version again replaces it.  Row counts are observed while the
        rows are written.
        """
        version = version or self.claim_version()
        parts, counts = {}, {}
        for name, df in tables.items():
            path = f"{self.folder(version)}/{name}"
            seen = Observation()
            counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            sinks.write_parquet(counted, path, rows_per_file, (partition_by or {}).get(name))
            parts[name], counts[name] = path, seen.get["rows"]
        manifest = {
            "version": version, "status": "ok", "parts": parts, "rows": counts, **dict(info or {}),
        }
        if len(parts) == 1:
            manifest["data_parts_prefix"] = next(iter(parts.values()))
        self.commit(manifest)
        return manifest

    def commit(self, manifest: dict) -> None:
        """Publish a manifest: beside the version, in the registry, and as latest if it is.

        A writer that reads the registry while another writes it lists both in the end, since
        manifests that are not listed are found in the version folders.
        """
        again = manifest["version"] in {self._name(e) for e in self._file()["versions"]}
        files.write_json(self.spark, f"{self.folder(manifest['version'])}/manifest.json", manifest)
        registry = self.registry()
        if self._enter(registry, manifest, again):
            files.write_json(self.spark, f"{self.root}/latest/manifest.json", manifest)
        files.write_json(self.spark, f"{self.root}/registry/{REGISTRY_NAMES[0]}", registry)

    def latest_source(self) -> tuple[str, str]:
        """(path, input kind) of the newest version.

        The entry's data_parts_prefix is preferred to its data_parquet, and that to the
        version folder's own ``parts``.
        """
        registry = self.registry()
        latest = registry.get("latest_version") or registry.get("latest")
        latest = self._name(latest) if latest else None
        if not latest:
            raise FileNotFoundError(f"no version is registered below {self.root}")
        entry = next(
            (e for e in registry["versions"] if self._name(e) == latest and isinstance(e, Mapping)), {}
        )
        if entry.get("data_parts_prefix"):
            return entry["data_parts_prefix"], "parts_prefix"
        if entry.get("data_parquet"):
            return entry["data_parquet"], "data_parquet"
        return f"{self.folder(latest)}/parts", "version_dir_fallback"

    def versions_with(self, split: str) -> list[str]:
        """Numbered versions that hold Parquet files for ``split``, oldest first."""
        return [
            v
            for v in files.folders(self.spark, f"{self.root}/versions")
            if re.fullmatch(r"v\d+", v) and files.has_parquet(self.spark, f"{self.folder(v)}/{split}")
        ]

    def resolve(self, split: str, version: str | None = None) -> str:
        """Folder of a split in the given version, or in the newest that has it."""
        found = self.versions_with(split)
        if version is None:
            if not found:
                raise FileNotFoundError(f"no version below {self.root} holds split {split}")
            version = max(found, key=lambda v: int(v[1:]))
        elif version not in found:
            raise FileNotFoundError(f"version {version} holds no Parquet for split {split}")
        return f"{self.folder(version)}/{split}"

    def read(self, part: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.resolve(part, version))
