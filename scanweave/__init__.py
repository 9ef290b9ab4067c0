"""Scene, fusion, tracking and change analytics over LiDAR tables, as Spark DataFrame operators."""
