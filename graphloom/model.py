"""Data model: node labels, relationship types, columns and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and relationship types of the graph.
NODE_LABELS = (
    "File Folder Function Class Interface Method CodeElement Community Process Struct Enum Macro Typedef Union Namespace Trait Impl TypeAlias "
    "Const Static Property Record Delegate Annotation Constructor Template Module Variable Dependency"
).split()
REL_TYPES = (
    "CONTAINS CALLS IMPORTS EXTENDS IMPLEMENTS HAS_METHOD HAS_PROPERTY OVERRIDES MEMBER_OF STEP_IN_PROCESS DEFINES ACCESSES USES DEPENDS_ON "
    "SPAWNS DELEGATES_TO CROSS_REPO_IMPORTS CROSS_REPO_CALLS CROSS_REPO_DEPENDENCY SHARED_TYPE"
).split()
CROSS_REPO_TYPES = REL_TYPES[-4:]
CALL_LIKE = ("CALLS", "SPAWNS", "DELEGATES_TO")

NODE_SCHEMA = (
    "id string, label string, labels array<string>, name string, filePath string, language string, size long, content string, startLine int, endLine int, "
    "isExported boolean, isTest boolean, description string, signature string, parameterCount int, returnType string, parameterTypes string, modularity double, "
    "communitySize int, entryPoint string, heuristicLabel string, stepCount int, callerCount int, importance double, crossCommunity boolean, version string, "
    "source string, devDep boolean, repoName string, props map<string,string>"
)
EDGE_SCHEMA = "edge_id string, src string, dst string, type string, confidence double, reason string, step int, accessKind string, props map<string,string>"


def symbol_id(label: Column, path: Column, owner: Column, name: Column) -> Column:
    """First 24 hex digits of SHA-256 over label, relative path and qualified name."""
    full = F.when(F.coalesce(owner, F.lit("")) == "", name).otherwise(F.concat(owner, F.lit("."), name))
    return F.substring(F.sha2(F.concat_ws(":", label, path, full), 256), 1, 24)


def edge_id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
