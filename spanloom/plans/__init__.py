"""Schemas of the logical tables."""

from __future__ import annotations

STAMP = "struct<provider:string,model:string,runId:string,timestamp:string>"
SEGMENT = f"struct<text:string,runId:string,provider:string,model:string,quality:string,timestamp:string,confirmations:array<{STAMP}>>"
PROVENANCE = f"struct<createdBy:{STAMP},lastConfirmedBy:{STAMP},confirmationCount:bigint>"
HISTORY = "struct<mergedId:string,mergedAt:string,mergedBy:string,mergedReason:string>"

#: seq is the order of insertion; every "first" and every stable sort goes by it.
ENTITIES = (
    "seq bigint, id string, name string, entityType string, ontologyClass string, layer string, description string, createdAt string, updatedAt string, "
    f"validFrom string, validUntil string, supersedes string, legacyId struct<system:string,id:string>, embedding array<double>, metadata map<string,string>, provenance {
        PROVENANCE
    }, "
    f"createdBy {STAMP}, lastConfirmedBy {STAMP}, confirmationCount bigint, descriptionSegments array<{SEGMENT}>, resolutionHistory array<{HISTORY}>"
)
RELATIONS = "seq bigint, key string, `from` string, `to` string, type string, metadata map<string,string>, createdAt string, validFrom string, validUntil string"
TOMBSTONES = "kind string, key string, at string, meta struct<project:string,team:string,domain:string>"
CLASSES = (
    "name string, source string, load_ord int, extends string, description string, defaultLayer string, relationships map<string,array<string>>, "
    "properties map<string,struct<type:string,required:boolean,enum:array<string>,format:string>>, level int, parent string"
)
SUPERSEDED_BY = "SUPERSEDED_BY"
