"""What a publication says of its accessibility, as statements to show.

Metadata are arrays of the terms that publications use: access modes, modes
that suffice, features and hazards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has(terms: Column, *names: str) -> Column:
    return F.arrays_overlap(F.coalesce(terms, F.array().cast("array<string>")), F.array(*map(F.lit, names)))


def visual_adjustments(features: Column, fixed_layout: Column) -> Column:
    return F.when(_has(features, "displayTransformability"), "modifiable").when(fixed_layout, "unmodifiable").otherwise("unknown")


def nonvisual_reading(modes: Column, sufficient: Column, features: Column) -> Column:
    """sufficient: an array of arrays of modes."""
    enough = F.coalesce(F.exists(sufficient, lambda s: (F.size(s) == 1) & (s[0] == "textual")), F.lit(False))
    text = _has(modes, "textual")
    described = _has(features, "alternativeText", "longDescription", "describedMath", "transcript")
    only_visual = F.coalesce((F.size(modes) == 1) & (modes[0] == "visual"), F.lit(False)) & ~described
    return F.when(enough, "readable").when(text | described, "partly readable").when(only_visual, "unreadable").otherwise("unknown")


def prerecorded_audio(modes: Column, sufficient: Column, features: Column) -> Column:
    enough = F.coalesce(F.exists(sufficient, lambda s: (F.size(s) == 1) & (s[0] == "auditory")), F.lit(False))
    return F.when(_has(features, "synchronizedAudioText"), "synchronized").when(enough, "audio only").when(_has(modes, "auditory"), "complementary").otherwise("unknown")


def navigation(features: Column) -> Column:
    """The statements that hold, in fixed order."""
    out = [F.when(_has(features, *terms), F.lit(text)) for terms, text in ((("tableOfContents",), "table of contents"), (("index",), "index"), (("structuralNavigation",), "headings"), (("pageNavigation", "pageBreakMarkers"), "pages"))]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def rich_content(features: Column) -> Column:
    table = (("MathML", "math as MathML"), ("latex", "math as LaTeX"), ("describedMath", "described math"), ("ChemML", "chemistry as MathML"), ("longDescription", "extended descriptions"), ("closedCaptions", "closed captions"), ("openCaptions", "open captions"), ("transcript", "transcript"))
    return F.filter(F.array(*[F.when(_has(features, k), F.lit(v)) for k, v in table]), lambda x: x.isNotNull())


def hazards(terms: Column) -> Column:
    """The hazards that are named, "none", or "unknown"."""
    named = F.filter(F.array(*[F.when(_has(terms, k), F.lit(k)) for k in ("flashing", "motionSimulation", "sound")]), lambda x: x.isNotNull())
    none = _has(terms, "none") | (_has(terms, "noFlashingHazard") & _has(terms, "noMotionSimulationHazard") & _has(terms, "noSoundHazard"))
    return F.when(F.size(named) > 0, named).when(none, F.array(F.lit("none"))).otherwise(F.array(F.lit("unknown")))
