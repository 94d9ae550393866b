"""What a collected query did: its plan's nodes with the rows that they made."""


def nodes(df, metric="numOutputRows"):
    """(name, metric) of the executed plan's nodes; *df* must have been collected."""
    return list(_below(df._jdf.queryExecution().executedPlan(), metric))


def _below(plan, metric):
    name, found = plan.nodeName(), plan.metrics().get(metric)
    if found.isDefined():
        yield name, found.get().value()
    if name == "AdaptiveSparkPlan":
        yield from _below(plan.executedPlan(), metric)
    elif name.endswith("QueryStage"):
        yield from _below(plan.plan(), metric)
    else:
        children = plan.children()
        for i in range(children.length()):
            yield from _below(children.apply(i), metric)


def moved(spark, run):
    """Rows that shuffles moved while *run* ran."""
    status, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = status.stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(found.apply, range(found.length()))}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)
