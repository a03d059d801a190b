"""kinetrace: Spark-native analytics over molecular-dynamics trajectories."""
