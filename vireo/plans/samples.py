"""A small synthetic corpus of declarations, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vireo.plans.index import Index, build, open_index
from vireo.session import shared_root

FILES = {
    "/core/1.0/core.txt": """-- | Values everyone needs.
@package core
@version 1.0

-- | Lists.
module Base.List

-- | Apply a function to every element,
--   in order.
each :: (a -> b) -> [a] -> [b]
first :: [a] -> a
sorted :: Ord a => [a] -> [a]
@url #special
pairs, couples :: [a] -> [b] -> [(a, b)]
collect :: (a -> [b]) -> [a] -> [b]
find :: Eq a => a -> [(a, b)] -> Maybe b

module Base.Types
data Bool
True :: Bool
type Text = [Char]
class Eq a => Ord a
instance Ord Bool
instance Ord Char
instance Eq Bool
(<+>) :: Text -> Text -> Text
length :: [a] -> Int
""",
    "/more/2.1/more.txt": """@package more
module More.List
-- | Apply a function to every element,
--   in order.
each :: (a -> b) -> [a] -> [b]
safeFirst :: [a] -> Maybe a
this line is no declaration ::
flipped :: [a] -> (a -> b) -> [b]
""",
}

METADATA = {
    "/core.cabal": "name: core\nversion: 1.0\nsynopsis: The core\nlicense: BSD3 OR MIT\nauthor: Ann Other and Bea Else <b@example.org>\nlibrary\n  build-depends: missing >= 1\n",
    "/more.cabal": "name: more\nversion: 2.1\ncategory: Data, Lists\nlibrary\n  build-depends: core ==1.*, missing\n",
    "/quiet.cabal": "name: quiet\nversion: 0.1\nsynopsis: Says nothing\nlibrary\n  build-depends: core\n",
}


def files(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, body binary")


_built: dict[str, str] = {}


def sample_index(spark: SparkSession) -> Index:
    """The index of this corpus, built once per session in the shared folder."""
    from uuid import uuid4

    from vireo.sources.files import parse_metadata

    app = spark.sparkContext.applicationId
    if app in _built:
        return open_index(spark, _built[app])
    path = f"{shared_root(spark)}/vireo-sample-{uuid4().hex}"
    even = spark.createDataFrame([("core",)], "package string")
    index = build(spark, files(spark, FILES), path, parse_metadata(files(spark, METADATA)), {"even": even}, settings='RenameTag "Bea-Else" "Bea"\nReorderModule "core" "Base.T*" 3\n')
    _built[app] = path
    return index
