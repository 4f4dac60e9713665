"""Line formats, generators and the table catalog."""
