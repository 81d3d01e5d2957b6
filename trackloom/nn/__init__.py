"""Feed-forward, recurrent, convolutional and temporal-convolutional networks over a track's frames; weights are given, never unpickled."""
