"""PySpark operators for AI-agent and model-API traffic: enrichment, payload
classification, sessions, identities, behaviour and policy over event tables."""

__version__ = "0.1.0"


def ship(spark) -> None:
    """Give the executors this package, once per session. Needed by the operators that run
    Python in tasks, unless the package is installed on every node."""
    import pathlib
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_palisade_shipped", False):
        return
    root = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="palisade-")) / "palisade.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, pathlib.Path("palisade") / source.relative_to(root))
    sc.addPyFile(str(archive))
    sc._palisade_shipped = True
