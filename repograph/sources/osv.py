"""Advisories of packages: from saved responses, or from the advisory service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.plans.vulnerabilities import ADVISORY, ECOSYSTEMS

URL = "https://api.osv.dev/v1/query"
RESPONSE = f"ecosystem string, name string, vulns array<{ADVISORY}>"


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """ecosystem, name, doc of JSON lines {ecosystem, name, vulns: [...]}."""
    return spark.read.schema(RESPONSE).json(path).select("ecosystem", "name", F.explode("vulns").alias("doc"))


class Service:
    """One connection to a service that answers JSON posts; opened when first asked, and again after a failure."""

    def __init__(self, timeout: int) -> None:
        self.timeout, self.open = timeout, {}

    def __call__(self, url: str, payload: dict) -> str:
        import http.client
        import json
        from urllib.parse import urlsplit

        at = urlsplit(url)
        if at.netloc not in self.open:
            kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
            self.open[at.netloc] = kind(at.netloc, timeout=self.timeout)
        line = self.open[at.netloc]
        try:
            line.request("POST", at.path or "/", json.dumps(payload), {"Content-Type": "application/json"})
            answer = line.getresponse()
            body = answer.read().decode()
        except (OSError, http.client.HTTPException) as e:
            self.open.pop(at.netloc).close()
            raise OSError(f"no answer from {at.netloc}") from e
        if answer.status != 200:
            raise OSError(f"{at.netloc} answered {answer.status}")
        return body


def fetch(packages: DataFrame, timeout: int = 60, parts: int = 8, url: str = URL, service=Service) -> DataFrame:
    """ecosystem, name, doc for packages (ecosystem, name): one request each, spread over `parts` tasks. A
    failed request, or an answer that is no JSON object, is no advisory."""
    known = dict(ECOSYSTEMS)  # service: what a task asks through, made with the timeout

    def ask(frames):
        import pandas as pd

        post = service(timeout)
        for f in frames:
            out = []
            for eco, name in zip(f["ecosystem"], f["name"], strict=True):
                try:
                    out.append((eco, name, post(url, {"package": {"name": name, "ecosystem": known[eco]}})))
                except (OSError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["ecosystem", "name", "body"])

    wanted = packages.where(F.col("ecosystem").isin(*known)).select("ecosystem", "name").distinct()
    got = wanted.repartition(parts, "ecosystem", "name").mapInPandas(ask, "ecosystem string, name string, body string")
    vulns = F.from_json("body", f"struct<vulns: array<{ADVISORY}>>")["vulns"]
    return got.select("ecosystem", "name", F.explode(vulns).alias("doc"))
