"""Labels in image bytes that say how an image was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 192 * 1024
LEAST_SIDE = 200

#: Names of generators, in the order in which they are looked for.
GENERATORS = [
    "DALL-E", "DALL·E", "OpenAI", "ChatGPT", "gpt-image", "Midjourney", "Adobe Firefly", "Firefly", "Imagen", "Gemini", "Stable Diffusion",
    "StableDiffusion", "stability.ai", "Ideogram", "Leonardo.Ai", "NovelAI", "Flux", "black-forest-labs", "Bing Image Creator", "Microsoft Designer", "Meta AI",
]
#: Marks in the bytes.
MANIFEST = "(?i)c2pa|jumb|cai:"
PARTLY, TRAINED = "compositeWithTrainedAlgorithmicMedia", "trainedAlgorithmicMedia"
PARAMETERS = r"(?s)parameters\x00.{0,4000}Steps: [0-9]+.{0,400}Sampler:"
WORKFLOW = r'(?s)(?:prompt|workflow)\x00.{0,200}"class_type"'


def scan(content: Column | str) -> Column:
    """struct of ai, kind, source. Only the head of the bytes is read, as one character a byte."""
    raw = F.substring(F.col(content) if isinstance(content, str) else content, 1, HEAD_BYTES)
    s = F.decode(raw, "ISO-8859-1")
    has = lambda x: F.contains(s, F.lit(x))
    manifest = s.rlike(MANIFEST)
    found = lambda ai, kind, source: F.struct(F.lit(ai).alias("ai"), F.lit(kind).alias("kind"), (source if isinstance(source, Column) else F.lit(source)).alias("source"))
    by = F.when(manifest, "c2pa").otherwise("iptc")
    generator = F.coalesce(*[F.when(has(g), F.lit(g)) for g in GENERATORS])
    return (
        F.when(has(PARTLY), found(True, "partly generated", by))
        .when(has(TRAINED), found(True, "generated", by))
        .when(has("parameters") & s.rlike(PARAMETERS), found(True, "generated", "stable diffusion metadata"))
        .when(has('"class_type"') & s.rlike(WORKFLOW), found(True, "generated", "comfyui metadata"))
        .when(manifest & generator.isNotNull(), found(True, "generated", F.concat(F.lit("c2pa · "), generator)))
        .when(manifest, found(False, "content credentials", "c2pa"))
        .otherwise(found(False, "no label", ""))
    )


def size_gate(df: DataFrame, width: str = "width", height: str = "height", url: str = "url") -> DataFrame:
    """Images of at least 200 by 200 with a web address."""
    return df.where((F.col(width) >= LEAST_SIDE) & (F.col(height) >= LEAST_SIDE) & F.col(url).rlike("^https?:"))


def once(df: DataFrame, url: str = "url") -> DataFrame:
    """One row a url."""
    return df.dropDuplicates([url])
