"""Command line (CLI1-6). Spark is started only when there is something to compute."""

from __future__ import annotations

import argparse
import importlib
import sys

from . import __version__
from .errors import EngineError, InputError
from .plans.registry import MODELS, resolve


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tonegrid", description="Score audio into time-indexed feature tables.")
    p.add_argument("args", nargs="*", metavar="MODEL… INPUT", help="models, then one input file or folder; or: viz browse SCORES")
    p.add_argument("-o", "--output", help="base path of the result tables; stdout without it")
    p.add_argument("--all", action="store_true", help="all models that can run here")
    p.add_argument("--stimulus-id", help="identity written to every row (default: the file's stem)")
    p.add_argument("--hop", type=float, default=0.5, help="grid step in seconds")
    p.add_argument("--asr-model", "--whisper-model", dest="asr_model", help="checkpoint of the transcription provider")
    p.add_argument("--clap-model", help="checkpoint of the audio-embedding provider")
    p.add_argument("--providers", help="Python module that registers providers when it is imported")
    p.add_argument("--probe", help="JSON file with the read-outs of music_emotion")
    p.add_argument("--language", help="language of the speech")
    p.add_argument("--verbatim", action="store_true", help="keep fillers and repetitions (English and German)")
    p.add_argument("--num-speakers", type=int, help="hint for diarisation")
    p.add_argument("--wordpool", help="item list of a free-recall experiment")
    p.add_argument("--title", help="title of a dashboard")
    p.add_argument("--audio", help="WAV file to embed in a dashboard")
    p.add_argument("--list-models", action="store_true")
    p.add_argument("--version", action="version", version=f"tonegrid {__version__}")
    return p


def check(o: argparse.Namespace, models: list[str]) -> None:
    """CLI4: rules between flags."""
    if o.hop <= 0:
        raise InputError("--hop must be positive")
    if o.verbatim and o.asr_model:
        raise InputError("--verbatim excludes a custom transcription checkpoint")
    if o.verbatim and o.language not in (None, "en", "de"):
        raise InputError("--verbatim knows English and German only")
    for flag, value, model in (("--wordpool", o.wordpool, "transcribe"), ("--verbatim", o.verbatim, "transcribe"), ("--num-speakers", o.num_speakers, "diarize")):
        if value and model not in models:
            raise InputError(f"{flag} needs the model {model}")


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tonegrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _options(o: argparse.Namespace) -> dict[str, dict]:
    """What the flags say to each provider; what was not said is left to the provider."""
    speech = {"checkpoint": o.asr_model, "language": o.language, "verbatim": o.verbatim or None}
    return {"transcribe": speech, "clap": {"checkpoint": o.clap_model}, "diarize": {"num_speakers": o.num_speakers}}


def runnable(providers, probe) -> tuple[list[str], list[str]]:
    """CLI3: models that can run here, and those that cannot."""
    can = [m.name for m in MODELS.values() if m.native or (all(providers.available(n) for n in (m.provider, *(["speech"] if m.gate == "speech" else []))) and (m.name != "music_emotion" or probe))]
    return can, [n for n in MODELS if n not in can]


def _score(o: argparse.Namespace) -> None:
    if not o.args:
        raise InputError("an input is needed")
    *models, path = o.args
    if o.providers:
        importlib.import_module(o.providers)
    if o.all:
        if models:
            raise InputError("--all takes no model names")
        from .providers import base

        models, left = runnable(base, o.probe)
        if left:
            print(f"tonegrid: without a provider here, left out: {', '.join(left)}", file=sys.stderr)
    if not models:
        raise InputError("name at least one model, or --all")
    resolve(models)
    check(o, models)
    from .sources.audio import input_type

    kind = input_type(path)
    from .plans.publish import to_stdout, write_csv
    from .plans.score import score
    from .providers import base, derived
    from .sources.audio import read_stimuli
    from .sources.files import read_wordpool

    said = _options(o)
    wanted = {n for m in resolve(models) if not m.native for n in (m.provider, *(["speech"] if m.gate == "speech" else []))}
    providers = {n: base.provider(n, **said.get(n, {})) for n in sorted(wanted) if base.available(n)}
    spark = _session()
    pool = read_wordpool(spark, o.wordpool) if o.wordpool else None
    probe = derived.read_probe(o.probe) if o.probe else None
    result = score(read_stimuli(spark, path), models, o.hop, wordpool=pool, providers=providers, probe=probe, verbatim=o.verbatim)
    if o.output:
        write_csv(result, o.output, {"path": path, "type": kind}, o.stimulus_id)
    else:
        to_stdout(result, sys.stdout)
    result.release()


def _browse(o: argparse.Namespace) -> None:
    if len(o.args) != 3 or o.args[1] != "browse":
        raise InputError("usage: tonegrid viz browse SCORES -o page.html")
    from .explore.dashboard import create_dashboard
    from .sources.files import read_scores

    tables = read_scores(_session(), o.args[2])
    audio = None
    if o.audio:
        with open(o.audio, "rb") as f:
            audio = f.read()
    create_dashboard(o.output or o.args[2].removesuffix(".csv") + ".html", o.title or o.args[2], tables.get("frames"), tables.get("transcript"), tables.get("meta"), audio)


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    try:
        if o.list_models:
            for m in MODELS.values():
                print(f"{m.name:16}{m.level:9}{'' if m.native else 'provider '}{m.description}")
        elif o.args[:1] == ["viz"]:
            _browse(o)
        else:
            _score(o)
    except (EngineError, ValueError, OSError, ImportError) as e:
        print(f"tonegrid: {e}", file=sys.stderr)
        return 1
    except Exception as e:
        if not type(e).__module__.startswith(("pyspark", "py4j")):
            raise
        print(f"tonegrid: {str(e).splitlines()[0]}", file=sys.stderr)  # a failed job: its first line, not the trace
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
