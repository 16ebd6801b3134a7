"""Object stores: paths from parts of a configuration, and the settings of Spark's connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.sources.files import SUFFIXES, format_of, read_file


def s3(config: dict) -> tuple[str, dict[str, str]]:
    """With a bucket, ``key`` names the object; else it is the access key, as ``access_key`` always is."""
    path = config.get("path") or (f"s3a://{config['bucket']}/{config['key']}" if config.get("bucket") and config.get("key") else None)
    if not path:
        raise ValueError("S3 needs path, or bucket and key")
    settings = {}
    access = config.get("access_key") or (config.get("key") if config.get("path") else None)
    for name, value in (("access.key", access), ("secret.key", config.get("secret")), ("session.token", config.get("token")), ("endpoint.region", (config.get("client_kwargs") or {}).get("region_name")), ("endpoint", (config.get("client_kwargs") or {}).get("endpoint_url"))):
        if value:
            settings[f"fs.s3a.{name}"] = str(value)
    return path.replace("s3://", "s3a://", 1), settings


def gcs(config: dict) -> tuple[str, dict[str, str]]:
    blob = config.get("blob") or config.get("key")
    path = config.get("path") or (f"gs://{config['bucket']}/{blob}" if config.get("bucket") and blob else None)
    if not path:
        raise ValueError("GCS needs path, or bucket and blob")
    settings = {}
    if isinstance(config.get("token"), str):
        settings = {"google.cloud.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE", "google.cloud.auth.service.account.json.keyfile": config["token"]}
    if config.get("project"):
        settings["fs.gs.project.id"] = str(config["project"])
    return path, settings


def azure(config: dict) -> tuple[str, dict[str, str]]:
    account, blob = config.get("account_name"), config.get("blob") or config.get("key")
    host = f"{account}.dfs.core.windows.net"
    path = config.get("path") or (f"abfs://{config['container']}@{host}/{blob}" if account and config.get("container") and blob else None)
    if not path:
        raise ValueError("Azure needs path, or account_name, container and blob")
    settings = {}
    if account and config.get("account_key"):
        settings[f"fs.azure.account.key.{host}"] = config["account_key"]
    elif account and config.get("sas_token"):
        settings |= {f"fs.azure.account.auth.type.{host}": "SAS", f"fs.azure.sas.fixed.token.{host}": config["sas_token"]}
    elif account and config.get("client_id"):
        settings |= {
            f"fs.azure.account.auth.type.{host}": "OAuth",
            f"fs.azure.account.oauth.provider.type.{host}": "org.apache.hadoop.fs.azurebfs.oauth2.ClientCredsTokenProvider",
            f"fs.azure.account.oauth2.client.id.{host}": config["client_id"],
            f"fs.azure.account.oauth2.client.secret.{host}": config["client_secret"],
            f"fs.azure.account.oauth2.client.endpoint.{host}": f"https://login.microsoftonline.com/{config['tenant_id']}/oauth2/token",
        }
    return path, settings


def hdfs(config: dict) -> tuple[str, dict[str, str]]:
    inner = config.get("hdfs_path") or config.get("key")
    path = config.get("path") or (f"hdfs://{config['host']}:{config.get('port') or 8020}/{inner.lstrip('/')}" if config.get("host") and inner else None)
    if not path:
        raise ValueError("HDFS needs path, or host and hdfs_path")
    return path, {}


STORES = {"s3": s3, "gcs": gcs, "azure_blob": azure, "hdfs": hdfs}


def read_store(spark: SparkSession, kind: str, config: dict, skiprows: int = 0, json_lines: bool = False) -> DataFrame:
    """An object as a DataFrame, lazily; a suffix that names no format raises, unless one is given. The connector's jar must be on the cluster."""
    path, settings = STORES[kind](config)
    if not config.get("format") and not path.lower().endswith(tuple(SUFFIXES)):
        raise ValueError(f"{path}: unknown suffix, and no format given")
    hadoop = spark._jsc.hadoopConfiguration()
    for k, v in settings.items():
        hadoop.set(k, v)
    return read_file(spark, path, format_of(path, config.get("format")), skiprows, json_lines)
