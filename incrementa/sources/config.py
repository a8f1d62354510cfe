"""Run configuration (CFG-1..7), simulation headers (SRC-10), result datasets (SNK-2..7)."""

from __future__ import annotations

import argparse
import os
import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from incrementa.functions.binning import Binning

ENVIRONMENT = "INCREMENTA_CONFIG"


@dataclass(slots=True)
class RunConfig:
    """Defaults of a run; n_processes is accepted and has no meaning here, as the cluster decides."""

    stride: int = 1
    n_disp_total: int = 1000
    n_random_subsamples: int = 1000
    n_ell_bins: int = 128
    n_processes: int = 0
    stencil_width: int = 2
    file_name: str | None = None
    slice_list: str | None = None


#: fixed values: other names by which files and flags call a setting
ALIASES = {"N_random_subsamples": "n_random_subsamples"}


@dataclass(slots=True)
class Settings:
    """What a configuration says beside a run's numbers: bins, the least density, where results go."""

    binning: Binning = Binning()
    min_density: float = 1e-10
    directory: str = "results"


def settings_of(config: dict) -> Settings:
    """The binning, physics and output sections; an unknown key is an error."""
    out = Settings()
    sections = {"binning": {f.name for f in fields(Binning)}, "physics": {"min_density"}, "output": {"directory"}}
    for name, known in sections.items():
        for k in config.get(name) or {}:
            if k not in known:
                raise ValueError(f"unknown setting {name}.{k}")
    bins = {k: tuple(map(float, v)) if isinstance(v, list) else v for k, v in (config.get("binning") or {}).items()}
    out.binning = Binning(**bins)
    out.min_density = float((config.get("physics") or {}).get("min_density", out.min_density))
    if out.min_density <= 0:
        raise ValueError("min_density must be positive")
    out.directory = str((config.get("output") or {}).get("directory", out.directory))
    return out


def deep_merge(base: dict, more: dict) -> dict:
    """``more`` over ``base``, nested tables merged; neither is changed."""
    out = dict(base)
    for k, v in more.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str | Path, profile: str | None = None) -> dict:
    """A YAML table, with the named profile merged over it; an empty file is an empty table."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    got = yaml.safe_load(Path(path).read_text()) or {}
    profiles = got.pop("profiles", {}) or {}
    if profile is None:
        return got
    if profile not in profiles:
        raise KeyError(profile)
    return deep_merge(got, profiles[profile] or {})


def default_path() -> Path | None:
    """The first that exists of ./incrementa.yaml, ./.incrementa.yaml, ~/.incrementa/config.yaml and the one the environment names."""
    named = os.environ.get(ENVIRONMENT)
    for p in (Path("incrementa.yaml"), Path(".incrementa.yaml"), Path.home() / ".incrementa" / "config.yaml", *([Path(named)] if named else [])):
        if p.exists():
            return p
    return None


def validate(cfg: RunConfig) -> RunConfig:
    for name in ("stride", "n_disp_total", "n_random_subsamples", "n_ell_bins"):
        if getattr(cfg, name) <= 0:
            raise ValueError(f"{name} must be positive")
    if cfg.stencil_width not in (2, 3, 5):
        raise ValueError("stencil_width must be 2, 3 or 5")
    if cfg.n_processes < 0:
        raise ValueError("n_processes must not be negative")
    if (cfg.file_name is None) == (cfg.slice_list is None):
        raise ValueError("give one of file_name and slice_list")
    return cfg


TEMPLATE = """# settings of a run; profiles are merged over them by name
analysis:
  stride: 1
  n_disp_total: 1000
  n_random_subsamples: 1000
  n_ell_bins: 128
  stencil_width: 2
binning:
  n_theta_bins: 18
  n_phi_bins: 18
  sf_range: [1.0e-4, 10.0]
  product_range: [1.0e-5, 1.0e+5]
  n_value_edges: 128
physics:
  min_density: 1.0e-10
output:
  directory: results
profiles:
  test:
    analysis: {stride: 4, n_disp_total: 50, n_random_subsamples: 100, n_ell_bins: 16}
  production:
    analysis: {n_disp_total: 5000, n_random_subsamples: 5000}
"""


def write_template(path: str | Path, overwrite: bool = False) -> Path:
    p = Path(path)
    if p.exists() and not overwrite:
        raise FileExistsError(p)
    p.write_text(TEMPLATE)
    return p


def parse_run(argv: list[str] | None = None, use_config: bool = True) -> tuple[RunConfig, Settings]:
    """Flags over the configuration's analysis table over the defaults, and the other sections; --print-config prints both and ends.

    An unknown key of the analysis table is an error, not left out.
    """
    parser = argparse.ArgumentParser(prog="incrementa")
    parser.add_argument("--config")
    parser.add_argument("--profile")
    parser.add_argument("--print-config", action="store_true", dest="show")
    for f in fields(RunConfig):
        names = [f"--{f.name}", *(f"--{other}" for other, own in ALIASES.items() if own == f.name)]
        parser.add_argument(*names, dest=f.name, type=int if f.type == "int" else str)
    args = vars(parser.parse_args(argv))
    path, profile, show = args.pop("config"), args.pop("profile"), args.pop("show")
    path = path or (default_path() if use_config else None)
    config = load_config(path, profile) if path else {}
    given = {ALIASES.get(k, k): v for k, v in (config.get("analysis") or {}).items()}
    if unknown := given.keys() - {f.name for f in fields(RunConfig)}:
        raise ValueError(f"unknown setting analysis.{sorted(unknown)[0]}")
    run, settings = RunConfig(**given | {k: v for k, v in args.items() if v is not None}), settings_of(config)
    if show:
        print(json.dumps({"analysis": asdict(run), "settings": asdict(settings)}, indent=2))
        raise SystemExit(0)
    return validate(run), settings


def parse_arguments(argv: list[str] | None = None, use_config: bool = True) -> RunConfig:
    return parse_run(argv, use_config)[0]


def read_header(text: str) -> dict[str, dict[str, str]]:
    """Sections ``<name>`` of ``key = value`` lines; # starts a comment."""
    out: dict[str, dict[str, str]] = {}
    section = None
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line.startswith("<") and line.endswith(">"):
            section = out.setdefault(line[1:-1].strip(), {})
        elif "=" in line and section is not None:
            k, v = line.split("=", 1)
            section[k.strip()] = v.strip()
    return out


def mesh_of(header: dict[str, dict[str, str]]) -> tuple[int, tuple[int, int, int]]:
    """(cells along an edge, block shape); KeyError where the header lacks one."""
    return int(header["mesh"]["nx1"]), tuple(int(header["meshblock"][f"nx{k}"]) for k in (1, 2, 3))


def write_result(parts: dict[str, DataFrame], meta: dict[str, object], path: str) -> None:
    """A result as a folder of Parquet datasets and one row of metadata as a map; the large table is laid out by channel."""
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("channel") if "channel" in df.columns else writer).parquet(f"{path}/{name}")
    spark.createDataFrame([({k: str(v) for k, v in meta.items()},)], "meta map<string,string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/run_meta")


def read_result(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_slice_list(spark: SparkSession, paths: list[str], path: str) -> None:
    spark.createDataFrame([(p,) for p in sorted(paths)], "value string").coalesce(1).write.mode("overwrite").text(path)
