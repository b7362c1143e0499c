"""Schemas of the landed documents and of the flat tables."""

from pyspark.sql import types as T

SERIES = ("node_name", "pod_namespace", "pod_name", "container_name")
POD = ("node_name", "pod_namespace", "pod_name")
SPEC_KEY = ("pod_namespace", "pod_name", "container_name")

# sample column -> short prefix used for its aggregates
METRICS = {"cpu_nano": "cpu", "mem_usage": "usage", "mem_ws": "ws"}

_UINT64 = T.DecimalType(20, 0)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


USAGE_DOCUMENT = _struct(
    node=_struct(nodeName=T.StringType()),
    pods=T.ArrayType(
        _struct(
            podRef=_struct(name=T.StringType(), namespace=T.StringType()),
            containers=T.ArrayType(
                _struct(
                    name=T.StringType(),
                    cpu=_struct(usageNanoCores=_UINT64),
                    memory=_struct(usageBytes=_UINT64, workingSetBytes=_UINT64),
                )
            ),
        )
    ),
)

_QUANTITIES = _struct(cpu=T.StringType(), memory=T.StringType())

OWNER_REFERENCES = T.ArrayType(
    _struct(kind=T.StringType(), name=T.StringType(), controller=T.BooleanType())
)

POD_LIST_DOCUMENT = _struct(
    items=T.ArrayType(
        _struct(
            metadata=_struct(
                name=T.StringType(),
                namespace=T.StringType(),
                ownerReferences=OWNER_REFERENCES,
            ),
            spec=_struct(
                containers=T.ArrayType(
                    _struct(
                        name=T.StringType(),
                        resources=_struct(requests=_QUANTITIES, limits=_QUANTITIES),
                    )
                )
            ),
            status=_struct(
                qosClass=T.StringType(),
                containerStatuses=T.ArrayType(
                    _struct(name=T.StringType(), restartCount=T.IntegerType())
                ),
            ),
        )
    )
)

_NAMED = _struct(name=T.StringType(), namespace=T.StringType())

ARGO_DOCUMENT = _struct(
    items=T.ArrayType(
        _struct(
            metadata=_NAMED,
            spec=_struct(source=_struct(repoURL=T.StringType(), path=T.StringType())),
            status=_struct(
                resources=T.ArrayType(
                    _struct(kind=T.StringType(), name=T.StringType(), namespace=T.StringType())
                )
            ),
        )
    )
)

FLUX_KUSTOMIZATION_DOCUMENT = _struct(
    items=T.ArrayType(
        _struct(
            metadata=_NAMED,
            spec=_struct(
                path=T.StringType(),
                sourceRef=_struct(
                    kind=T.StringType(), name=T.StringType(), namespace=T.StringType()
                ),
            ),
            status=_struct(inventory=_struct(entries=T.ArrayType(_struct(id=T.StringType())))),
        )
    )
)

FLUX_REPOSITORY_DOCUMENT = _struct(
    items=T.ArrayType(_struct(metadata=_NAMED, spec=_struct(url=T.StringType())))
)

# Sample metadata carried next to the usage columns, with the value used when it is absent.
METADATA_DEFAULTS = {
    "cpu_request_millis": 0,
    "cpu_limit_millis": 0,
    "mem_request_bytes": 0,
    "mem_limit_bytes": 0,
    "restart_count": 0,
    "qos_class": "",
    "owner_kind": "",
    "owner_name": "",
}

METADATA_TYPES = {
    "cpu_request_millis": "bigint",
    "cpu_limit_millis": "bigint",
    "mem_request_bytes": "bigint",
    "mem_limit_bytes": "bigint",
    "restart_count": "int",
    "qos_class": "string",
    "owner_kind": "string",
    "owner_name": "string",
}

SAMPLE = T.StructType(
    [
        T.StructField("node_name", T.StringType()),
        T.StructField("pod_namespace", T.StringType()),
        T.StructField("pod_name", T.StringType()),
        T.StructField("container_name", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("cpu_nano", _UINT64),
        T.StructField("mem_usage", _UINT64),
        T.StructField("mem_ws", _UINT64),
    ]
)

MAPPING = _struct(
    namespace=T.StringType(),
    kind=T.StringType(),
    name=T.StringType(),
    repo_url=T.StringType(),
    path=T.StringType(),
    source_tool=T.StringType(),
)
