"""posekit: pose-tracking and behaviour analytics as Spark DataFrame operators."""
